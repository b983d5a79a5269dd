"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 10).

Two fingerprints within three bits: leave out one of three blocks of bits in which they differ, and at
most two bits differ in the rest, so both are one flip away from a common middle. Every distinct
fingerprint therefore emits, for each block left out, the rest and all its one-flip variants; fingerprints
that share a variant are compared bit by bit. Copies fall together before that, and a group sends a
spanning tree of its links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.blocks import pack_keys, unpack_keys
from netquarry.llm.common import components, kept, small_batches, stored
from netquarry.llm.suffixes import mix

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEED = 42
BITS = 64
#: Least hashes of a run that makes texts candidates; texts of a block that are compared with another block.
ROWS, BLOCK = 5, 256
#: Blocks of each side of a larger group, up to so many texts in a block; pairs in doubt that a cell holds at once.
SIDES, WIDEST, PORTION = 4, 1 << 16, 1 << 20
#: Four standard deviations of a share of 0.8 estimated by 128 least hashes.
MARGIN = 0.14
JUDGED = "a bigint, b bigint, sure boolean"
#: Bits of a shingle's hash: two sets of 1,000 shingles meet by chance in one with a probability of 4e-9.
GRAM = 48
#: Low bits of a doubtful cell's name: which of the runs of least hashes it is about; with all set it may be any.
TAG = 255


def simhash(text: str | None, shingle: int) -> int:
    """Fingerprint of a text: bits that are set in over half the hashes of its word shingles."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    hashed = xxhash.xxh64_intdigest
    h = np.fromiter((hashed(line[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i: i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def grams(text: str, shingle: int) -> np.ndarray:
    """Hashes of the distinct word shingles, in order; fewer words than a shingle make one, no words none."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = max(1, len(words) - shingle + 1)
    found = {xxhash.xxh3_64_intdigest(line[a:b]) >> 64 - GRAM for a, b in zip(starts[:k].tolist(), ends[-k:].tolist())}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def traits(text: str, shingle: int, size: int) -> bytes:
    """The least hashes of the shingles under `size` mixings."""
    return least_of(grams(text, shingle), size)


def least_of(h: np.ndarray, size: int) -> bytes:
    """The least of these hashes of shingles under `size` mixings."""
    if not len(h):
        return bytes(4 * size)
    mult = np.random.default_rng(11).integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(size, np.iinfo(np.uint64).max)
    for i in range(0, len(h), 4096):
        x = h[i: i + 4096, None] * mult
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(0))
    return (least >> np.uint64(20)).astype(np.uint32).tobytes()


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (64 bits as a long) of every row; a null text is an empty one, whose fingerprint is 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return small_batches(docs).select(F.col(doc_id).cast("bigint"), F.col(text).cast("string")).mapInArrow(run, "doc_id bigint, fp bigint")


def masks(blocks: int) -> list[tuple[int, int]]:
    """(bits to keep, bit to flip or 0) of every variant; both as signed longs."""
    edges = [round(BITS * i / blocks) for i in range(blocks + 1)]
    signed = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
    out = []
    for a, b in zip(edges, edges[1:]):
        keep = ((1 << BITS) - 1) ^ (((1 << (b - a)) - 1) << a)
        out += [(signed(keep), signed(1 << i if i < BITS else 0)) for i in range(BITS + 1) if i == BITS or keep >> i & 1]
    return out


def tree(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the links among distinct fingerprints, by breadth-first search."""
    rest = fps
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            top, front = front[0], front[1:]
            near = np.bitwise_count(rest ^ top) <= radius
            if near.any():
                found = rest[near]
                yield np.full(len(found), top), found
                front, rest = np.concatenate([front, found]), rest[~near]


def links(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs among rows sorted by key; all of short runs, a spanning forest of long ones."""
    a, b = [], []
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(cut, len(key)))
    for width in range(2, 9):
        at = cut[size == width]
        for i in range(width):
            for j in range(i + 1, width):
                hit = (np.bitwise_count(fp[at + i] ^ fp[at + j]) <= radius) & (fp[at + i] != fp[at + j])
                a.append(fp[at[hit] + i])
                b.append(fp[at[hit] + j])
    for s, n in zip(cut[size > 8], size[size > 8]):
        for x, y in tree(np.unique(fp[s: s + n]), radius):
            a.append(x)
            b.append(y)
    empty = np.empty(0, np.uint64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def close(distinct: DataFrame, radius: int = 3, blocks: int = 3) -> DataFrame:
    """Pairs a, b (fingerprints within the radius of 3 or less) that connect what all such pairs connect.

    distinct: one column fp without repeats. A group that shares a variant is bounded by the ball around
    it: the flips of the rest times the values of the block left out.
    """
    if radius > 3:
        raise ValueError("one flip on both sides and one block left out reach three bits")
    # Dealt by the key, but sent with the number of the variant, which takes less room than the key.
    keep, flip = (F.array(*map(F.lit, x)) for x in zip(*masks(blocks)))
    variant = F.explode(F.array(*(F.lit(i).cast("smallint") for i in range(len(masks(blocks))))))
    key = F.col("fp").bitwiseAND(keep[F.col("m")]).bitwiseXOR(flip[F.col("m")])
    rows = distinct.select("fp", variant.alias("m")).repartition(key).select(key.alias("key"), "fp").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0
            yield packed(*links(key[:whole], fp[:whole], radius))
            key, fp = key[whole:], fp[whole:]
        if len(key):
            yield packed(*links(key, fp, radius))

    def packed(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays(
            [pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64))], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(
    docs: DataFrame, shingle: int = 3, radius: int = 3, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest id reachable by links) of every row.

    Fingerprints link at `radius` or fewer differing bits. A null or blank text has fingerprint zero and
    links like any other; fewer words than a shingle make one shingle. Repeated ids give a row each. A row
    whose id is null gets a component by the ids of the others, or null if none of them has one.
    """
    own = kept(fingerprints(docs, shingle, doc_id, text))
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(close(distinct.select("fp"), radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = rooted.join(least, "root").select("fp", "component_id")
    return own.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def balls(marks: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs a, b of nodes that connect all whose fingerprints are within the radius: node, fp in, one row a node."""
    heads = kept(marks.groupBy("fp").agg(F.min("node").alias("head")))
    same = marks.join(heads, "fp").where("head <> node").select(F.col("head").alias("a"), F.col("node").alias("b"))
    side = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}"))
    near = close(heads.select("fp"), radius).join(side("a"), "a").join(side("b"), "b")
    return same.unionByName(near.select(F.col("head_a").alias("a"), F.col("head_b").alias("b")))


def bands(least: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A key for every run of so many least hashes of each row; rows with one key have that run in common."""
    count = least.shape[1] // rows
    mult = np.random.default_rng(12).integers(1, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    runs = least[:, : count * rows].reshape(len(least), count, rows).astype(np.uint64)
    return mix((mix(runs * mult) * mult).sum(2, dtype=np.uint64) + mix(np.arange(1, count + 1, dtype=np.uint64)))


def forest(
    comp: np.ndarray, least: np.ndarray, low: float, high: float, holds: Callable[[int, int], bool] | None = None, run: int = 0,
) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Edges that join components, and the places that remain in doubt.

    Places that agree at `high` or more are joined first. Of those at `low` or more that are still apart `holds`
    decides, one by one as long as they are apart; without it they are returned. A pair in doubt that has one of the
    first `run` runs of ROWS least hashes in common is left to the cells of that run, so of all the runs that two texts
    share only the first asks about them. There is never an edge more than it takes to join the components.
    """
    comp, edges, doubt, asked, held = np.unique(comp, return_inverse=True)[1], [], np.zeros(len(comp), bool), [], 0

    def join(x: int, y: int) -> None:
        edges.append((x, y))
        comp[comp == comp[y]] = comp[x]

    def settle() -> None:
        xs, ys = np.concatenate([np.empty((2, 0), np.int64), *asked], axis=1)
        apart = comp[xs] != comp[ys]
        xs, ys = xs[apart], ys[apart]
        if holds is None:
            doubt[xs] = doubt[ys] = True
            return
        for x, y in zip(xs.tolist(), ys.tolist()):
            if comp[x] != comp[y] and holds(x, y):
                join(x, y)

    for x in range(len(comp) - 1):
        other = np.flatnonzero(comp[x + 1:] != comp[x]) + x + 1
        equal = least[other] == least[x]
        share = equal.mean(1)
        for y in other[share >= high].tolist():
            if comp[y] != comp[x]:
                join(x, y)
        doubtful = np.flatnonzero((share >= low) & (share < high))
        if run:
            earlier = equal[doubtful, : run * ROWS].reshape(len(doubtful), run, ROWS).all(2).any(1)
            doubtful = doubtful[~earlier]
        some = other[doubtful]
        asked.append(np.stack([np.full(len(some), x), some]))
        held += len(some)
        if held > PORTION:
            settle()
            asked, held = [], 0
    settle()
    return edges, np.flatnonzero(doubt)


def by_cell(rows: DataFrame, decide: Callable[[int, list[tuple]], list[tuple]]) -> DataFrame:
    """What `decide` makes of each cell's rows; the first column names the cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            found: list[tuple] = []
            for cell, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if cell != now:
                    found += decide(now, held) if len(held) > 1 else []
                    now, held = cell, []
                held.append(row)
            yield judged(found)
        if len(held) > 1:
            yield judged(decide(now, held))

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, JUDGED)


def apart(
    shared: DataFrame, roots: DataFrame, marks: DataFrame, texts: DataFrame, shingle: int, similarity: float,
    low: float, high: float, block: int = BLOCK, size: int = 128,
) -> DataFrame:
    """Edges a, b that connect what pairs of one band key, but of different components, connect at `similarity`.

    shared: key, node. A key's members are those of its first member's component, the base, and the rest. The rest
    is compared with itself and with the base in cells of two blocks, and what has come together costs no comparisons
    with itself. A side has SIDES blocks at most, so a member goes to 2 * SIDES cells however large its group, until
    blocks hold WIDEST members. A cell is decided by the least hashes where they suffice;
    where they do not, the doubtful members' shingles come to it, once each, and it decides by them. Texts with several
    keys in common are in doubt at the first of them only, so a text does not bring its shingles to every key that it
    shares. A cell gives fewer edges than it has members, however many pairs are close.
    """
    named = shared.join(roots, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    first = named.groupBy("key").agg(F.min("comp").alias("base"), F.max("comp").alias("top")).where("base <> top").drop("top")
    members = stored(named.join(first, "key").withColumn("rest", F.col("comp") != F.col("base")).drop("base"))
    parts = lambda n: F.greatest(F.least(F.ceil(n / block), F.lit(SIDES)), F.ceil(n / WIDEST)).cast("int")
    blocks = members.groupBy("key").agg(
        parts(F.sum(F.col("rest").cast("int"))).alias("r"), parts(F.sum((~F.col("rest")).cast("int"))).alias("b"))
    salt = lambda n: F.pmod(F.xxhash64("node", F.lit(5)), F.col(n)).cast("int")
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cells = F.when(F.col("rest"), F.concat(
        F.transform(upto("r"), lambda t: cell(0, F.least(t, salt("r")), F.greatest(t, salt("r")))),
        F.transform(upto("b"), lambda t: cell(1, salt("r"), t)),
    )).otherwise(F.transform(upto("r"), lambda t: cell(1, t, salt("b"))))
    least = marks.select("node", "least")
    # Every member gets its least hashes once, before it goes to its cells.
    rows = members.join(blocks, "key").join(least, "node").select("node", "comp", "least", F.col("key").alias("k"), F.explode(cells).alias("c"))
    rows = rows.select(F.xxhash64("k", "c.kind", "c.i", "c.j").alias("cell"), "node", "comp", "least", "k")

    def by_least(cell_: int, rows_: list[tuple]) -> list[tuple]:
        node, comp, marked, key = zip(*rows_)
        least_ = np.frombuffer(b"".join(marked), np.uint32).reshape(len(node), -1)
        run = np.flatnonzero(bands(least_[:1])[0].view(np.int64) == key[0])[:1].tolist()
        tag = run[0] if run and run[0] < TAG and len(set(key)) == 1 else TAG
        edges, doubt = forest(np.array(comp, np.int64), least_, low, high, run=tag % TAG)
        return [(node[x], node[y], True) for x, y in edges] + [(cell_ & ~TAG | tag, node[x], False) for x in doubt.tolist()]

    def by_shingles(cell_: int, rows_: list[tuple]) -> list[tuple]:
        node, comp, packed, count = zip(*rows_)
        sets = lru_cache(64)(lambda x: unpack_keys(packed[x], count[x]) if count[x] else np.empty(0, np.uint64))
        # Least hashes are made again from the shingles, so that they need not travel with them.
        least_ = np.frombuffer(b"".join(least_of(sets(x), size) for x in range(len(node))), np.uint32).reshape(len(node), -1)

        def holds(x: int, y: int) -> bool:
            both = len(np.intersect1d(sets(x), sets(y), assume_unique=True))
            return both >= similarity * (count[x] + count[y] - both)

        edges, _ = forest(np.array(comp, np.int64), least_, low, high, holds, (cell_ & TAG) % TAG)
        return [(node[x], node[y], True) for x, y in edges]

    found = stored(by_cell(rows, by_least))
    doubtful = found.where("NOT sure").select(F.col("a").alias("cell"), F.col("b").alias("node"))
    # As a table the nodes have a known size, by which Spark decides whether the texts must move to meet them.
    wanted = stored(doubtful.select("node").distinct())
    bodies = texts.select("node", "text").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [grams(t, shingle) for t in batch.column(1).to_pylist()]
            packed = [pack_keys(s) if len(s) else b"" for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(packed, pa.binary()), pa.array([len(s) for s in sets], pa.int64())], ["node", "shingles", "count"])

    full = doubtful.join(bodies.mapInArrow(shingled, "node bigint, shingles binary, count bigint"), "node")
    full = full.join(roots, "node", "left").select("cell", "node", F.coalesce("component", "node").alias("comp"), "shingles", "count")
    return found.where("sure").select("a", "b").unionByName(by_cell(full, by_shingles).select("a", "b")).distinct()


def holding(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Pairs a, b that are sure or whose shingle sets agree at `similarity` or more.

    pairs: a, b, sure. texts: node, text, with repeats.
    """
    unsure = pairs.where("NOT sure").select("a", "b")
    nodes = stored(unsure.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    bodies = texts.select("node", "text").join(nodes, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    body = lambda c: bodies.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, x = None, np.empty(0, np.uint64)
        for batch in batches:
            hold = []
            for a, text_a, text_b in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != node:
                    node, x = a, grams(text_a.as_py(), shingle)
                y = grams(text_b.as_py(), shingle)
                both = len(np.intersect1d(x, y, assume_unique=True))
                hold.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(hold, pa.bool_()))

    exact = unsure.join(body("a"), "a").join(body("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")
    return pairs.where("sure").select("a", "b").unionByName(exact)


def judged(rows: list[tuple[int, int, bool]]) -> pa.RecordBatch:
    a, b, sure = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sure, pa.bool_())], ["a", "b", "sure"])


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, size: int = 128) -> DataFrame:
    """The rows of docs without near-duplicates: of each group the row with the smallest id stays.

    Texts are linked if the sets of their word shingles agree at `similarity` or more. First candidates are, for each
    text, its least neighbour by the links of operator 10 (fingerprints within three bits, met by ball hashing) and the
    first one of its runs of ROWS least hashes. Three bits do not reach all pairs at the similarity, so then all of a
    run are compared that this has not brought together (of pairs at 0.8 all but 0.00005 have a run in common). What
    `size` least hashes estimate within MARGIN of the similarity is decided by the sets themselves.
    Equal texts fall together first, blank ones too. Of rows with equal id and text one stays; rows without an id go
    only where another copy has one.
    """
    own = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(1).to_pylist()
            fp = np.array([simhash(t, 3) for t in bodies], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(fp), pa.array([traits(t, shingle, size) for t in bodies], pa.binary())],
                ["doc_id", "node", "fp", "least"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = bands(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, size))
            node = np.repeat(batch.column(0).to_numpy(), found.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(found.ravel().view(np.int64)), pa.array(node)], ["key", "node"])

    low, high = similarity - MARGIN, similarity + MARGIN

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, size) for i in (2, 3))
            share = (x == y).mean(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share >= high)], ["a", "b", "sure"]).filter(pa.array(share >= low))

    texts = own.withColumn("node", F.xxhash64("text"))
    named = kept(texts.select("doc_id", "text", "node").mapInArrow(run, "doc_id bigint, node bigint, fp bigint, least binary"))
    firsts = named.groupBy("node").agg(F.min("doc_id").alias("first"))
    marks = kept(named.select("node", "least", "fp").dropDuplicates(["node"]))
    keyed = marks.select("node", "least").mapInArrow(keys, "key bigint, node bigint")
    heads = keyed.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head <> last").drop("last")
    shared = kept(keyed.join(heads, "key"))
    # Every text is asked about its least neighbour by fingerprint (all of them would be many pairs in a large group of
    # near copies) and one head, the least of its runs'; the rest is for `apart`.
    asked = shared.groupBy("node").agg(F.min("head").alias("head")).where("head <> node").select(F.col("head").alias("a"), F.col("node").alias("b"))
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    nearest = balls(marks.select("node", "fp")).select(*ordered).groupBy("b").agg(F.min("a").alias("a"))
    asked = nearest.unionByName(asked.select(*ordered)).distinct()
    mark = lambda c: marks.select(F.col("node").alias(c), F.col("least").alias(f"least_{c}"))
    stars = asked.join(mark("a"), "a").join(mark("b"), "b").select("a", "b", "least_a", "least_b").mapInArrow(agree, JUDGED)
    near = kept(holding(kept(stars), texts, shingle, similarity))
    rest = apart(shared.select("key", "node"), components(near), marks, texts, shingle, similarity, low, high, size=size)
    roots = components(near.unionByName(rest))
    rooted = firsts.join(roots, "node", "left").select("node", "first", F.coalesce("component", "node").alias("root"))
    keepers = rooted.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), F.coalesce("first", F.lit(0)).alias("first"), "node")).alias("k"))
    keepers = stored(keepers.select(F.when(~F.col("k.none"), F.col("k.first")).alias("id"), F.col("k.node").alias("node")))
    hashed = docs.withColumn("__node", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    same = F.col("__node").eqNullSafe(F.col("node")) & F.col("doc_id").cast("bigint").eqNullSafe(F.col("id"))
    out = hashed.join(keepers, same, "left_semi")
    again = named.join(keepers, named["node"].eqNullSafe(keepers["node"]) & named["doc_id"].eqNullSafe(keepers["id"]), "left_semi")
    if again.groupBy("node", "doc_id").count().where("count > 1").isEmpty():
        return out.select(*docs.columns)
    return out.dropDuplicates(["doc_id", "__node"]).select(*docs.columns)
