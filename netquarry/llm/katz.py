"""Language-model scores by Katz backoff (operator 3).

P(w | h) = d(c(hw)) c(hw) / c(h) where the pair was seen in training, else a(h) P(w); the counts are
discounted by Good and Turing at both levels, and a(h) makes every context's probabilities add up to one,
the unknown word included.

Documents are dealt into blocks by a hash of their ids. A block sends its distinct words and pairs, as sorted
64-bit hashes with their counts, to the partitions of the count tables, which are cut by ranges of the hash;
these add up what all blocks sent and answer each block in the order of its own keys. One block of those
that hold a pair (the first) then adds it to its context's sums, which go to partitions and back in the same
way; with the counts and the backoff weights of its own words and pairs, a block scores its documents token by
token. So no table is held or sent whole: a task holds one block or one partition, and what moves is the
distinct words and pairs of each block, packed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.blocks import SENT, aligned, deal, merged, pack, rows_of, sent, texts_of, unpack
from netquarry.llm.common import kept, whole

#: Counts up to this one are discounted by Good and Turing.
TURING = 5
#: Text bytes of a block, and the least number of blocks.
BLOCK_BYTES, LEAST_BLOCKS = 16 << 20, 24
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: White space can't be in a word, so these hashes stand for no word.
BEGIN, END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" begin", b" end"))

WORD, PAIR, STATS, WEIGHT = range(4)


def pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit key of each ordered pair of hashes."""
    x = h * np.uint64(0x9E3779B97F4A7C15) ^ (w + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@dataclass
class Block:
    """Tokens of a block: word and context of each as indexes of `words`, pair of each as one of `pairs`."""

    learn: np.ndarray
    sizes: np.ndarray
    words: np.ndarray
    word: np.ndarray
    context: np.ndarray
    pairs: np.ndarray
    pair: np.ndarray
    begins: np.ndarray

    def trained(self) -> np.ndarray:
        return np.repeat(self.learn, self.sizes)


def block_of(table: pa.Table) -> Block:
    """columns: doc_id, text, learn."""
    digest = xxhash.xxh3_64_intdigest
    parts, sizes = [], []
    for text in texts_of(table):
        words = text.translate(LOWER).split()
        parts.append(np.fromiter(map(digest, words), np.uint64, len(words)))
        sizes.append(len(words) + 1)
    size = np.array(sizes, np.int64)
    ends = np.cumsum(size)
    token = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    before = np.empty_like(token)
    for part, e in zip(parts, ends):
        s = e - len(part) - 1
        token[s: e - 1] = part
        token[e - 1] = END
        before[s] = BEGIN
        before[s + 1: e] = part
    words, inverse = np.unique(np.concatenate([token, [BEGIN]]), return_inverse=True)
    word = inverse[:-1].astype(np.int32)
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[ends - size] = inverse[-1]
    pairs, pair = np.unique(pair_keys(before, token), return_inverse=True)
    return Block(table.column("learn").to_numpy(), size, words, word, context, pairs, pair.astype(np.int32), ends - size)


def send_counts(table: pa.Table, parts: int) -> pa.Table:
    """A block's words and pairs with their counts in training documents."""
    b, block = block_of(table), table.column("block")[0].as_py()
    seen = b.trained().astype(np.float64)
    counts = np.bincount(b.word, seen, minlength=len(b.words))
    counts[np.searchsorted(b.words, BEGIN)] = b.learn.sum()
    pairs = np.bincount(b.pair, seen, minlength=len(b.pairs))
    return rows_of(sent(block, WORD, b.words, counts.astype(np.uint64), None, parts)
                   + sent(block, PAIR, b.pairs, pairs.astype(np.uint64), None, parts))


def answer_counts(table: pa.Table) -> pa.Table:
    """Counts over all blocks, for each block in the order of its keys; statistics of the partition's counts."""
    rows, places, keys, first = merged(table)
    total = np.zeros(len(keys), np.uint64)
    for r, at in zip(rows, places):
        total[at] += unpack(r["x"], np.uint64, r["n"])
    part, kind = rows[0]["part"], rows[0]["kind"]
    out, done = [], 0
    for r, at in zip(rows, places):
        own = np.zeros(r["n"], np.uint8)
        mine = first[(first >= done) & (first < done + r["n"])] - done
        own[mine] = 1
        done += r["n"]
        out.append((part, r["block"], kind, r["n"], b"", pack(total[at]), pack(own)))
    counted = total[keys != BEGIN] if kind == WORD else total
    stats = [int(counted.sum()), int((counted > 0).sum()), *(int((counted == r).sum()) for r in range(1, TURING + 2))]
    out.append((part, -1, STATS, kind, b"", np.array(stats, ">i8").tobytes(), b""))
    return rows_of(out)


def discounts(of_count: list[int]) -> np.ndarray:
    """Good-Turing factors of counts 0 to TURING + 1 from n_1 to n_{TURING+1}; the last stands for all above.

    A factor outside 0 to 1, as small tables give, is replaced by taking half a count off.
    """
    n = [0, *of_count]
    out = np.ones(TURING + 2)
    out[0] = 0.0
    for r in range(1, TURING + 1):
        d = -1.0
        if n[1] and n[r]:
            tail = (TURING + 1) * n[TURING + 1] / n[1]
            if tail < 1:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail)
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


@dataclass
class Totals:
    """What the whole corpus gives: tokens, distinct words, discounts of words and pairs, the unknown word's share."""

    tokens: int
    distinct: int
    word: np.ndarray
    pair: np.ndarray
    unknown: float

    def share(self, counts: np.ndarray) -> np.ndarray:
        """P(w) from counts; 0 stands for the unknown word."""
        c = counts.astype(np.float64)
        if not self.tokens:
            return np.ones(len(c))
        return np.where(c > 0, self.word[np.minimum(counts, TURING + 1).astype(np.int64)] * c / self.tokens, self.unknown)

    def pair_mass(self, counts: np.ndarray) -> np.ndarray:
        return self.pair[np.minimum(counts, TURING + 1).astype(np.int64)] * counts


def totals(answers: DataFrame) -> Totals:
    """From the statistics of all partitions; a few numbers for each come to the driver's sum through a reduction."""
    width = TURING + 3
    # n holds the kind, x the numbers as big-endian longs.
    value = lambda i: F.conv(F.hex(F.substring("x", 8 * i + 1, 8)), 16, 10).cast("bigint")
    sums = {r["n"]: [r[f"s{i}"] for i in range(width)] for r in answers.where(F.col("kind") == STATS).groupBy("n").agg(
        *(F.sum(value(i)).alias(f"s{i}") for i in range(width))).collect()}
    words, pairs = sums.get(WORD, [0] * width), sums.get(PAIR, [0] * width)
    by_word, by_pair = discounts(words[2:]), discounts(pairs[2:])
    lost = sum(r * words[1 + r] * (1 - by_word[r]) for r in range(1, TURING + 1))
    tokens = words[0]
    if tokens and not lost:
        # Every word is frequent: half a count of each goes to the unknown word.
        by_word, lost = by_word * (1 - 0.5 * words[1] / tokens), 0.5 * words[1]
    return Totals(tokens, words[1], by_word, by_pair, lost / tokens if tokens else 1.0)


def send_sums(table: pa.Table, answers: pa.Table, parts: int, known: Totals) -> pa.Table:
    """For each context of a block: the mass of the pairs that the block owns, and the shares of their words."""
    if not table.num_rows:
        return rows_of([])
    b, block = block_of(table), table.column("block")[0].as_py()
    count = aligned(answers, WORD, "x", np.uint64)
    pairs, own = aligned(answers, PAIR, "x", np.uint64), aligned(answers, PAIR, "y", np.uint8)
    at = np.empty(len(b.pairs), np.int64)
    at[b.pair] = np.arange(len(b.pair))
    use = (own > 0) & (pairs > 0)
    at, pairs = at[use], pairs[use]
    mass = np.bincount(b.context[at], known.pair_mass(pairs), minlength=len(b.words))
    share = np.bincount(b.context[at], known.share(count)[b.word[at]], minlength=len(b.words))
    scaled = mass / np.maximum(count, 1)
    return rows_of(sent(block, WEIGHT, b.words, scaled, share, parts))


def answer_weights(table: pa.Table) -> pa.Table:
    """Backoff weight of each context, for each block in the order of its words."""
    rows, places, keys, _ = merged(table)
    mass, share = np.zeros(len(keys)), np.zeros(len(keys))
    for r, at in zip(rows, places):
        mass[at] += unpack(r["x"], np.float64, r["n"])
        share[at] += unpack(r["y"], np.float64, r["n"])
    weight = np.maximum(1 - mass, 1e-12) / np.maximum(1 - share, 1e-12)
    return rows_of([(r["part"], r["block"], WEIGHT, r["n"], b"", pack(weight[at]), b"") for r, at in zip(rows, places)])


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score_block(table: pa.Table, answers: pa.Table, known: Totals) -> pa.Table:
    names = [c.split()[0] for c in SCORED.split(", ")]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    if not table.num_rows:
        return pa.Table.from_arrays([pa.array([], k) for k in kinds], names)
    b = block_of(table)
    count, pairs = aligned(answers, WORD, "x", np.uint64), aligned(answers, PAIR, "x", np.uint64)
    weight = aligned(answers, WEIGHT, "x", np.float64)
    c = count[b.word].astype(np.float64)
    base = np.log10((c + 0.1) / (known.tokens + 0.1 * (known.distinct + 1)))
    seen = pairs[b.pair]
    direct = known.pair_mass(seen) / np.maximum(count[b.context], 1)
    share = known.share(count)
    p = np.where(seen > 0, direct, np.where(count[b.context] > 0, weight[b.context], 1.0) * share[b.word])
    add = lambda x: np.add.reduceat(x, b.begins)
    return pa.Table.from_arrays([
        pa.array(table.column("doc_id").to_pylist(), pa.int64()), pa.array(~b.learn), pa.array(b.sizes), pa.array(add((c > 0).astype(np.int64))),
        pa.array(np.full(len(b.sizes), known.tokens)), pa.array(add(base)), pa.array(add(np.log10(p)))], names)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, least: int = LEAST_BLOCKS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row.

    The model learns from rows whose crc32 of the id as text is not 0 by mod 10; a row without an id is held
    out. A null text is an empty one: one token, the end. Repeated rows are learnt from and scored each. With
    nothing to learn from, every probability is 1. Unknown words share one probability.
    """
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole(F.col(text)).alias("text"), (F.crc32(key) % 10 != 0).alias("learn"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(least, -(-size // block_bytes))
    dealt = deal(rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")))
    counts = dealt.groupBy("block").applyInArrow(lambda t: send_counts(t, parts), SENT)
    answers = kept(counts.groupBy("kind", "part").applyInArrow(answer_counts, SENT))
    known = totals(answers)
    replies = answers.where(F.col("block") >= 0)
    sums = dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(lambda t, a: send_sums(t, a, parts, known), SENT)
    weights = sums.groupBy("part").applyInArrow(answer_weights, SENT)
    return dealt.groupBy("block").cogroup(replies.unionByName(weights).groupBy("block")).applyInArrow(
        lambda t, a: score_block(t, a, known), SCORED)
