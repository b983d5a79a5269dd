"""Token counts by rank-synchronous merging of ragged arrays (operator 4).

The distinct pre-tokens of a batch lie one after another in a numpy array of symbols. In each round
every sequence finds its lowest-ranked adjacent pair and merges all its occurrences at once; sequences
without a pair leave. A count is the number of symbols that survive.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import small_batches, whole
from netquarry.llm.pretokens import Memory, groups, pieces

MODEL_FILE = "byte_bpe_50k.json"
NONE = np.int64(1) << 40


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Ragged:
    """Counts the tokens of texts by the merges of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        self.width = np.int64(max(vocab.values()) + 1)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        # All occurrences may merge at once if no merge makes a pair that ranks before it.
        born = {int(x): r for r, x in reversed(list(enumerate(made)))}
        self.together = all(born.get(int(x), -1) < r for r, (a, b) in enumerate(zip(left, right)) for x in (a, b))
        key = left * self.width + right
        self.order = np.argsort(key, kind="stable")
        self.key = key[self.order]
        self.made = made
        self.symbol = np.array([vocab[c] for _, c in sorted(byte_letters().items())], np.int64)
        self.special = [t["content"] for t in spec.get("added_tokens", ()) if t["content"]]
        self.memory = Memory()

    def ranks(self, flat: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each symbol; NONE at the end of a sequence or without a merge."""
        out = np.full(len(flat), NONE)
        if len(flat) > 1:
            key = flat[:-1] * self.width + flat[1:]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = (self.key[at] == key) & ~last[:-1]
            out[:-1][hit] = self.order[at[hit]]
        return out

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Number of tokens of each word."""
        sizes = np.array([len(w) for w in words], np.int64)
        done = sizes.copy()
        live = np.flatnonzero(sizes > 1)
        flat = self.symbol[np.frombuffer(b"".join(words[i] for i in live), np.uint8)]
        sizes = sizes[live]
        while len(live):
            start = np.cumsum(sizes) - sizes
            last = np.zeros(len(flat), bool)
            last[start + sizes - 1] = True
            rank = self.ranks(flat, last)
            low = np.minimum.reduceat(rank, start)
            go = low < NONE
            done[live[~go]] = sizes[~go]
            if not go.any():
                break
            of = np.repeat(np.arange(len(live)), sizes)
            hit = (rank == low[of]) & go[of]
            # In a run of overlapping pairs, as in a a a a, every second one merges from the left.
            at = np.flatnonzero(hit)
            fresh = np.ones(len(at), bool)
            fresh[1:] = (at[1:] != at[:-1] + 1) | (of[at[1:]] != of[at[:-1]])
            run = np.maximum.accumulate(np.where(fresh, at, 0))
            at = at[(at - run) % 2 == 0]
            if not self.together:
                at = at[np.unique(of[at], return_index=True)[1]]
            flat[at] = self.made[rank[at]]
            stay = go[of]
            stay[at + 1] = False
            sizes = np.bincount(of[stay], minlength=len(live))[go]
            flat, live = flat[stay], live[go]
        return done

    def results(self, pieces: list[str]) -> list[int]:
        return self.counts([p.encode() for p in pieces]).tolist()

    def parts(self, text: str) -> tuple[int, list[str]]:
        """Special strings in a text are one token each and cut it; leftmost first, then longest."""
        if not any(s in text for s in self.special):
            return 0, pieces(text)
        number, cut, at = 0, [], 0
        while found := [(i, -len(s)) for s in self.special if (i := text.find(s, at)) >= 0]:
            i, size = min(found)
            cut += pieces(text[at:i])
            number, at = number + 1, i - size
        return number, cut + pieces(text[at:])

    def texts(self, texts: list[str]) -> Iterator[int]:
        for run in groups(texts):
            cut = [self.parts(t) for t in run]
            self.memory.trim()
            self.memory.learn({p for _, c in cut for p in c}, self.results)
            get = self.memory.__getitem__
            for number, c in cut:
                yield number + sum(map(get, c))


@lru_cache(1)
def ragged(path: str) -> Ragged:
    return Ragged(path)


def count_tokens(docs: DataFrame, model: str | None = None, text: str = "text", limit: int = 1024) -> DataFrame:
    """The table without its text, with n_bytes, n_tokens and over_limit (more than limit tokens) of every whole text.

    model: path of a tokenizer file, the same on every executor. A null text is an empty one: no bytes,
    no tokens. Every row, repeated or not, gives one row; an input column with the name of a new one is
    replaced.
    """
    path = model or public_tokenizers.path(MODEL_FILE)
    new = ["n_bytes", "n_tokens", "over_limit"]
    rest = [c for c in docs.columns if c not in (*new, text)]
    inner = small_batches(docs).select(*rest, whole(F.col(text)).alias("n_tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = ragged(path)
        for batch in batches:
            texts = batch.column(len(rest)).to_pylist()
            n = list(counter.texts(texts))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(rest)], pa.array([len(t.encode()) for t in texts], pa.int64()),
                 pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], [*rest, *new])

    types = dict(inner.select(*rest).dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in rest)
    return inner.mapInArrow(run, f"{schema}{', ' * bool(rest)}n_bytes bigint, n_tokens bigint, over_limit boolean")
