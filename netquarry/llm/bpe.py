"""Byte-level BPE by merge replay over the distinct words of many texts (operator 9).

Each task gathers the distinct pre-tokens of a batch of texts, holds their symbols in one linked list
and keeps an inverted index from the rank of a pair to the places where the pair stands. Ranks are
taken in order; a merge touches only the two neighbours of each place, whose new pairs enter the index.
Ids equal those of the public library for rank files: a pre-token that is itself in the vocabulary is
one id; otherwise the lowest rank in the pre-token goes first, leftmost first.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import small_batches, whole
from netquarry.llm.pretokens import Memory, groups, pieces

RANK_FILE = "byte_bpe_50k.tiktoken"


class Replay:
    """Encodes words by ranks and decodes ids."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            lines = [x.split() for x in f if x.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in lines}
        self.bytes_of = {r: t for t, r in self.rank.items()}
        self.single = [self.rank[bytes([i])] for i in range(256)]
        self.pair: dict[int, int] = {}
        self.memory = Memory()

    def pair_rank(self, a: int, b: int) -> int:
        """Rank of the merge of two ids, -1 if there is none."""
        key = a << 32 | b
        r = self.pair.get(key)
        if r is None:
            r = self.rank.get(self.bytes_of[a] + self.bytes_of[b], -1)
            if len(self.pair) > 500_000:
                self.pair.clear()
            self.pair[key] = r
        return r

    def words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word; all words are merged together, rank after rank."""
        out: list[list[int]] = [[self.rank[w]] if w in self.rank else [] for w in words]
        todo = [i for i, w in enumerate(words) if w and not out[i]]
        ids: list[int] = []
        word: list[int] = []
        ends: list[int] = []
        for i in todo:
            ids.extend(map(self.single.__getitem__, words[i]))
            word.extend([i] * len(words[i]))
            ends.append(len(ids))
        n = len(ids)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        start = 0
        for e in ends:
            after[e - 1] = -1
            before[start] = -1
            start = e
        places: dict[int, list[int]] = {}
        pair_rank = self.pair_rank
        for p in range(n):
            q = after[p]
            if q >= 0 and (r := pair_rank(ids[p], ids[q])) >= 0:
                places.setdefault(r, []).append(p)
        heap = list(places)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            left: list[int] = []
            held = -1  # a word with a new pair of lower rank, which goes first
            for p in sorted(set(places.pop(r, ()))):
                q = after[p]
                if ids[p] < 0 or q < 0 or pair_rank(ids[p], ids[q]) != r:
                    continue
                if word[p] == held:
                    left.append(p)
                    continue
                ids[p], ids[q] = r, -1
                after[p] = s = after[q]
                if s >= 0:
                    before[s] = p
                for a, b in ((before[p], p), (p, s)):
                    if a >= 0 and b >= 0 and (k := pair_rank(ids[a], ids[b])) >= 0:
                        if k < r:
                            held = word[p]
                        if k not in places:
                            places[k] = []
                            heapq.heappush(heap, k)
                        places[k].append(a)
            if left:
                places.setdefault(r, []).extend(left)
                heapq.heappush(heap, r)
        for i, x in zip(word, ids):
            if x >= 0:
                out[i].append(x)
        return out

    def packed(self, pieces: list[str]) -> list[bytes]:
        return [array("I", x).tobytes() for x in self.words([p.encode() for p in pieces])]

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        for run in groups(texts):
            cut = [pieces(t) for t in run]
            self.memory.trim()
            self.memory.learn({p for c in cut for p in c}, self.packed)
            get = self.memory.__getitem__
            for c in cut:
                yield b"".join(map(get, c))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids)))


@lru_cache(1)
def replay(path: str) -> Replay:
    return Replay(path)


def encode(docs: DataFrame, ranks: str | None = None, text: str = "text", ids: bool = False) -> DataFrame:
    """The table without its text, with n_tokens, ids_sha256 and decoded_sha256 of every whole text; with ids also token_ids.

    ranks: path of a rank file, the same on every executor. A null text is an empty one and has no
    tokens; every row, repeated or not, gives one row; an input column with the name of a new one is
    replaced. Texts of any length are encoded whole.
    """
    path = ranks or public_tokenizers.path(RANK_FILE)
    new = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids"] * ids
    rest = [c for c in docs.columns if c not in (*new, text)]
    inner = small_batches(docs).select(*rest, whole(F.col(text)).alias("token_ids" if ids else "ids_sha256"))
    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(),
             "token_ids": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = replay(path)
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in new}
            for packed in model.texts(batch.column(len(rest)).to_pylist()):
                rows["n_tokens"].append(len(packed) // 4)
                rows["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(model.decode(packed)).hexdigest())
                if ids:
                    rows["token_ids"].append(array("i", packed).tolist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(rest)], *(pa.array(rows[c], kinds[c]) for c in new)], [*rest, *new])

    types = dict(inner.select(*rest).dtypes)
    ddl = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string", "token_ids": "array<int>"}
    schema = ", ".join([f"`{c}` {types[c]}" for c in rest] + [f"{c} {ddl[c]}" for c in new])
    return inner.mapInArrow(run, schema)
