"""Phrases of several words by marginalising the longest windows (operator 13).

At every word a window of four words opens, padded where its piece ends before. Only these windows are counted;
Spark's ROLLUP over (language, first, second, third, fourth word) sums them to their shorter prefixes, and the sums of
all prefixes of k words are the frequencies of all phrases of k words.

Windows are counted in tasks first, then by places: a window's place is a hash of its first two words, of three where
so many windows begin with these two that one task should not hold them, or of all four. What begins alike is
therefore together, and a window can be cut there, before it is summed up, to the longest prefix that reaches the
least frequency: no phrase that reaches it is lost, and its sum stays whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from netquarry.llm.blocks import pack, unpack
from netquarry.llm.common import kept, small_batches
from netquarry.llm.suffixes import mix

ORDER = 4
WORDS = [f"w{k}" for k in range(1, ORDER + 1)]
#: A-Z in lower case, every mark that ends a piece as a full stop.
SIGNS = bytes(46 if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words of which a task counts the windows at once; windows that a place should have at most.
TOGETHER, PLACE = 3 << 20, 4 << 20
#: No list of hot prefixes gets longer than twice this, however large the input.
FINEST = 1 << 16


class Windows:
    """Words of one language as numbers, in order, 0 between pieces."""

    def __init__(self, lang: str):
        self.lang, self.ids, self.parts, self.size = lang, {b".": 0}, [], 0

    def add(self, texts: list[bytes]) -> None:
        words = b" . ".join(texts).translate(SIGNS).replace(b".", b" . ").split()
        ids = self.ids
        for w in words:
            if w not in ids:
                ids[w] = len(ids)
        self.parts += [np.fromiter(map(ids.__getitem__, words), np.int64, len(words)), np.zeros(ORDER, np.int64)]
        self.size += len(words)

    def counted(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Words from the most frequent on; distinct windows as rows of numbers from 1, 0 for padding; their counts."""
        a = np.concatenate(self.parts)
        use = np.bincount(a, minlength=len(self.ids))
        use[0] = np.iinfo(use.dtype).max
        order = np.argsort(-use, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        names = list(self.ids)
        a = rank[a]
        starts = np.flatnonzero(a)
        rows = np.stack([a[np.minimum(starts + k, len(a) - 1)] for k in range(ORDER)], 1)
        for k in range(1, ORDER):
            rows[:, k] *= rows[:, k - 1] > 0
        return ([names[i] for i in order[1:]], *summed(rows, np.ones(len(rows), np.int64)))


def summed(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, in order, and the sums of n."""
    if not len(rows):
        return rows, n
    key = rows[:, 0]
    for k in range(1, rows.shape[1]):
        # Numbers of distinct prefixes, in order, stay below the number of rows.
        if k > 1:
            key = np.unique(key, return_inverse=True)[1]
        key = key << 32 | rows[:, k]
    order = np.argsort(key)
    first = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    return rows[order[first]], np.add.reduceat(n[order], np.flatnonzero(first))


def names(words: list[bytes], lang: str) -> np.ndarray:
    """A hash of every word in its language; padding is 0."""
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.array([0, *(xxhash.xxh3_64_intdigest(w, seed) for w in words)], np.uint64)


def prefixes(rows: np.ndarray, hashed: np.ndarray) -> list[np.ndarray]:
    """Hashes of the prefixes of one, two, three and four words."""
    out = [mix(hashed[rows[:, 0]])]
    for k in range(1, ORDER):
        out.append(mix(out[-1] * np.uint64(0x9E3779B97F4A7C15) + hashed[rows[:, k]]))
    return out


def read_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[Windows]:
    """Windows of one language each, of at most TOGETHER words or one batch above it."""
    held: dict[str, Windows] = {}
    for batch in batches:
        by: dict[str, list[bytes]] = {}
        for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if t:
                by.setdefault(lang, []).append(t.encode("utf-8", "surrogatepass"))
        for lang, texts in by.items():
            if lang not in held:
                held[lang] = Windows(lang)
            held[lang].add(texts)
        if sum(w.size for w in held.values()) > TOGETHER:
            yield from held.values()
            held = {}
    yield from held.values()


def hot(rows: DataFrame) -> tuple[int, dict[int, int]]:
    """Words in all, and hashes of prefixes of two or three words with their counts, where some task has many of them.

    A prefix with more than 1.5/FINEST of all words is always listed, one with under 0.5/FINEST never.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in read_windows(batches):
            words, windows, n = own.counted()
            total = int(n.sum())
            hashed = prefixes(windows, names(words, own.lang))
            found, count = [np.zeros(1, np.uint64)], [np.array([total])]
            for k in (2, 3):
                real = windows[:, k - 1] > 0
                # Equal prefixes follow each other.
                h, m = hashed[k - 1][real], n[real]
                at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
                sums = np.add.reduceat(m, at) if len(h) else m
                many = sums * FINEST >= total
                found.append(h[at[many]])
                count.append(sums[many])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(count))], ["prefix", "n"])

    sums = rows.mapInArrow(run, "prefix bigint, n bigint").groupBy("prefix").agg(F.sum("n").alias("n"))
    sums = kept(sums)
    total = sums.where("prefix = 0").agg(F.max("n")).first()[0] or 0
    listed = sums.where((F.col("prefix") != 0) & (F.col("n") * (2 * FINEST) >= total))
    return total, {r["prefix"]: r["n"] for r in listed.toLocalIterator()}


PACKET = "place int, lang string, level int, size int, n_rows int, words binary, rows binary, n binary"


def frequent(docs: DataFrame, least: int, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, w1 to w4, n: all windows, each cut to the longest prefix of at least so many occurrences (one word at least)."""
    spark = docs.sparkSession
    rows = small_batches(docs).select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    total, listed = hot(rows)
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PLACE))
    share = max(total / count, total / FINEST) / 2
    many = spark.sparkContext.broadcast(np.sort(np.array([h for h, n in listed.items() if n >= share], np.int64).view(np.uint64)))

    def among(h: np.ndarray) -> np.ndarray:
        if not len(many.value):
            return np.zeros(len(h), bool)
        return many.value[np.minimum(np.searchsorted(many.value, h), len(many.value) - 1)] == h

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        for own in read_windows(batches):
            words, windows, n = own.counted()
            hashed = prefixes(windows, names(words, own.lang))
            level = np.full(len(windows), 2)
            level[among(hashed[1]) & (windows[:, 1] > 0)] = 3
            level[(level == 3) & among(hashed[2]) & (windows[:, 2] > 0)] = 4
            place = (np.choose(level - 2, hashed[1:]) % np.uint64(count)).astype(np.int64)
            order = np.argsort(place * 4 + level, kind="stable")
            key = (place * 4 + level)[order]
            cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else []
            packets = []
            for a, b in zip(cut, [*cut[1:], len(key)]):
                part, m = windows[order[a:b]], n[order[a:b]]
                used = np.unique(part)
                used = used[used > 0]
                short = np.searchsorted(used, part) + 1
                short[part == 0] = 0
                # The first column only grows, and packs as differences.
                short[1:, 0] = np.diff(short[:, 0])
                packets.append({
                    "place": int(place[order[a]]), "lang": own.lang, "level": int(level[order[a]]), "size": len(used), "n_rows": len(part),
                    "words": zip_.compress(b"\n".join([words[i - 1] for i in used.tolist()])),
                    "rows": pack(short.T.astype(np.uint32).reshape(-1)), "n": pack(m.astype(np.uint64)),
                })
            yield pa.RecordBatch.from_pylist(packets, schema)

    def cut_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        packets: dict[tuple[str, int], list[dict]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                packets.setdefault((r["lang"], r["level"]), []).append(r)
        for (name, level), own in packets.items():
            ids: dict[bytes, int] = {}
            parts, counts = [], []
            for r in own:
                words = unzip.decompress(r["words"]).split(b"\n")
                here = np.array([0, *(ids.setdefault(w, len(ids) + 1) for w in words)], np.int64)
                part = unpack(r["rows"], np.uint32, ORDER * r["n_rows"]).reshape(ORDER, -1).T.astype(np.int64)
                part[:, 0] = np.cumsum(part[:, 0])
                parts.append(here[part])
                counts.append(unpack(r["n"], np.uint64, r["n_rows"]).astype(np.int64))
            windows, n = summed(np.concatenate(parts), np.concatenate(counts))
            length = np.full(len(windows), level - 1)
            for k in range(level, ORDER + 1):
                new = np.concatenate([[True], (windows[1:, :k] != windows[:-1, :k]).any(1)])
                at = np.flatnonzero(new)
                sums = np.add.reduceat(n, at)[np.cumsum(new) - 1]
                length[(sums >= least) & (windows[:, k - 1] > 0)] = k
            for k in range(1, ORDER):
                windows[:, k] *= length > k
            windows, n = summed(windows, n)
            table = pa.array(list(ids), pa.binary()).cast(pa.string())
            for a in range(0, len(windows), 1 << 16):
                some = windows[a: a + (1 << 16)]
                columns = [table.take(pa.array(c - 1, mask=c == 0)) for c in some.T]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(some), pa.string()), *columns, pa.array(n[a: a + (1 << 16)])], ["lang", *WORDS, "n"])

    schema = pa.schema([(c.split()[0], {"int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]) for c in PACKET.split(", ")])
    dealt = rows.mapInArrow(deal, PACKET).repartitionById(count, F.col("place"))
    return dealt.mapInArrow(cut_short, f"lang string, {', '.join(f'{w} string' for w in WORDS)}, n bigint")


def frequencies(windows: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of all phrases of one to four words with at least so many occurrences, and (lang, n)."""
    sums = windows.rollup("lang", *WORDS).agg(F.sum("n").alias("f"), F.grouping_id().alias("g"))
    # Of k columns that are not summed over, the last must be a word: padding stands for no phrase.
    length = reduce(lambda c, k: c.when(F.col("g") == (1 << (ORDER - k)) - 1, k), range(ORDER), F.when(F.col("g") == 0, ORDER))
    sums = kept(sums.withColumn("k", length).where(
        f"k = 0 OR f >= {least} AND get(array({', '.join(WORDS)}), k - 1) IS NOT NULL"))
    words = F.slice(F.array(*WORDS), 1, F.col("k"))
    found = sums.where("k > 0").select("lang", words.alias("words"), F.array_join(words, " ").alias("phrase"), "f")
    return found, sums.where("k = 0").select("lang", F.col("f").alias("n"))


def wide(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def mine(
    docs: DataFrame, least: int = 30, top: int = 2000, inside: int = 80, lang: str = "lang", text: str = "text",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two to four words.

    Texts, A-Z in lower case, are split at `. , ; : ! ?` and line ends into pieces, pieces at blanks and tabs into words.
    A phrase needs a >= `least` occurrences. Its score is floor(2000000 a / (l + r)) for the frequencies of the two
    parts of the cut where that is least, the first of equal cuts. A phrase goes if a longer one around it has
    `inside` hundredths of its occurrences or more. Equal scores go by a, then by phrase in byte order.
    Null and empty texts have no words; a null language is `und`; repeated rows count again.
    """
    found, sizes = frequencies(frequent(docs, least, lang, text), least)
    candidates = found.where(F.size("words") > 1)
    cuts = candidates.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut"))
    both = cuts.select(
        "lang", "phrase", "a", "cut", F.array_join(F.expr("slice(words, 1, cut)"), " ").alias("left"),
        F.array_join(F.expr("slice(words, cut + 1, size(words) - cut)"), " ").alias("right"))
    part = lambda c, f: found.select("lang", F.col("phrase").alias(c), F.col("f").alias(f))
    both = both.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    scored = both.withColumn("score", F.expr("CAST(CAST(a AS decimal(20,0)) * 2000000BD div (CAST(l AS decimal(20,0)) + CAST(r AS decimal(20,0))) AS bigint)"))
    least_cut = scored.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("s"))

    inner = F.expr("flatten(transform(sequence(2, size(words) - 1), k -> transform(sequence(1, size(words) - k + 1), i -> array_join(slice(words, i, k), ' '))))")
    around = candidates.where(F.size("words") > 2).select("lang", "f", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    alone = least_cut.join(around, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * inside))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = alone.select("lang", "phrase", "a", F.col("s.l").alias("l"), F.col("s.r").alias("r"), F.col("s.score").alias("score"))
    ranked = ranked.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
