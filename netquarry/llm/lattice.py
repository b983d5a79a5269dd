"""Embedding near-duplicates by E8 lattice hashing (operator 5).

Each unit vector is projected at random to a few groups of eight coordinates, each group is decoded to its
nearest point of the lattice E8, and the points together name a cell, in several tables. A vector also
enters the neighbouring cells nearest to it. Vectors that share a cell are compared by cosine in double
precision, in blocks; a block sends a spanning forest of its links. The links of a component are then
counted in blocks as well. Equal vectors count as one throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import components, kept

#: Parameters: tables, groups of eight coordinates, neighbouring cells, lattice units per unit of length.
TABLES, GROUPS, PROBES, SCALE = 6, 2, 6, 0.65
#: Vectors of a block; a group of n vectors makes about (n / BLOCK)^2 / 2 tasks' worth of comparisons.
BLOCK = 128


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: the steps to the neighbouring cells."""
    pairs = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            pairs.append(v)
    halves = [np.array(s) / 2 for s in product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(pairs + halves)


ROOTS = roots()


def nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest point with whole coordinates of even sum: round, and where the sum is odd round the worst the other way."""
    p = np.rint(y)
    odd = p.sum(-1).astype(np.int64) % 2 != 0
    err = y - p
    worst = np.abs(err).argmax(-1)
    fix = np.where(np.take_along_axis(err, worst[..., None], -1) >= 0, 1.0, -1.0)
    changed = p.copy()
    np.put_along_axis(changed, worst[..., None], np.take_along_axis(p, worst[..., None], -1) + fix, -1)
    return np.where(odd[..., None], changed, p)


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """Nearest lattice point: the better of the whole and the half-shifted even points."""
    a, b = nearest_d8(y), nearest_d8(y - 0.5) + 0.5
    closer = ((y - a) ** 2).sum(-1) <= ((y - b) ** 2).sum(-1)
    return np.where(closer[..., None], a, b)


def unit(vectors: np.ndarray) -> np.ndarray:
    v = np.asarray(vectors, np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def cells(x: np.ndarray, tables: int, groups: int, probes: int, scale: float, seed: int) -> np.ndarray:
    """Keys of the own and the neighbouring cells of unit vectors, one row per vector."""
    out = []
    for t in range(tables):
        rng = np.random.default_rng([seed, t, x.shape[1]])
        plane = rng.standard_normal((x.shape[1], groups * 8)) * scale
        mult = rng.integers(1, 1 << 63, groups * 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        salt = rng.integers(1, 1 << 63, dtype=np.uint64)
        y = (x @ plane).reshape(len(x), groups, 8)
        point = nearest_e8(y)
        weight = lambda p: (np.rint(p * 2).astype(np.int64).astype(np.uint64) * mult.reshape(groups, 8))
        home = weight(point).sum((1, 2), dtype=np.uint64) + salt
        gain = (y - point) @ ROOTS.T
        best = np.argsort(-gain.reshape(len(x), -1), axis=1, kind="stable")[:, :probes]
        step = (np.rint(ROOTS * 2).astype(np.int64).astype(np.uint64)[None] * mult.reshape(groups, 1, 8)).sum(2, dtype=np.uint64)
        out += [home[:, None], home[:, None] + step.reshape(-1)[best]]
    h = np.concatenate(out, 1)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def emit_cells(vectors: DataFrame, tables: int, groups: int, probes: int, scale: float, seed: int) -> DataFrame:
    """node and key for each cell that a vector (node, v) enters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                node, lists = part.column(0).to_numpy(), part.column(1)
                size = np.diff(lists.offsets.to_numpy())
                for d in np.unique(size):
                    pick = np.flatnonzero(size == d)
                    v = np.array(lists.take(pa.array(pick)).to_pylist(), np.float64)
                    keys = cells(unit(v), tables, groups, probes, scale, seed)
                    keys = np.sort(keys.view(np.int64), axis=1)
                    first = np.concatenate([np.ones((len(keys), 1), bool), keys[:, 1:] != keys[:, :-1]], 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(node[pick], first.sum(1))), pa.array(keys[first])], ["node", "key"])

    return vectors.select("node", "v").mapInArrow(run, "node bigint, key bigint")


def in_blocks(
    members: DataFrame, size: str, block: int, kernel: Callable[[np.ndarray, np.ndarray, np.ndarray, bool], list], schema: str,
) -> DataFrame:
    """kernel(nodes, weights, sides, same) over the pairs of blocks of each group.

    members: grp, node, weight, v and the group's size. A group is cut by a hash of its nodes into blocks of
    about `block` rows; every pair of blocks, and every block with itself, is a small group of its own, so a
    large group spreads over many tasks and no task holds more than a few blocks.
    """
    n = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    rows = (
        members.withColumn("n", n).withColumn("i", own)
        .withColumn("j", F.explode(F.expr("sequence(0, n - 1)")))
        .select("grp", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"),
                (F.col("i") < F.col("j")).cast("int").alias("side"), "node", "weight", "v")
        .repartition("grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]

        def done(table: pa.Table) -> pa.RecordBatch:
            grp, lo, hi, side, node, weight = (table.column(i).to_numpy() for i in range(6))
            at = np.flatnonzero((grp[1:] != grp[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            bounds = [0, *at.tolist(), len(grp)]
            x = unit(np.array(table.column(6).to_pylist(), np.float64))
            parts = [kernel(node[a:b], weight[a:b], side[a:b], lo[a] == hi[a], x[a:b]) for a, b in zip(bounds, bounds[1:]) if b > a]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in parts])) for k in range(len(names))], names)

        held: pa.Table | None = None
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = pa.Table.from_batches([batch.slice(start, 4096)])
                held = part if held is None else pa.concat_tables([held, part])
                last = [held.column(i)[-1].as_py() for i in range(3)]
                tail = np.ones(held.num_rows, bool)
                for i in range(3):
                    tail &= held.column(i).to_numpy() == last[i]
                cut = int(tail.argmax())
                # Vectors of different length never share a group, so each group is a matrix.
                for table in by_length(held.slice(0, cut)):
                    yield done(table)
                held = held.slice(cut)
        if held is not None and held.num_rows:
            for table in by_length(held):
                yield done(table)

    def by_length(table: pa.Table) -> Iterator[pa.Table]:
        size = np.array([len(v) for v in table.column(6)], np.int64)
        for d in np.unique(size):
            yield table.filter(pa.array(size == d))

    return rows.mapInArrow(run, schema)


def forest(least: float) -> Callable:
    """Edges of a spanning forest of the links between the two sides, or within one block."""
    def kernel(node: np.ndarray, weight: np.ndarray, side: np.ndarray, same: bool, x: np.ndarray) -> list:
        link = x @ x.T >= least
        if not same:
            link &= side[:, None] != side[None, :]
        np.fill_diagonal(link, False)
        a, b = [], []
        fresh = link.any(1)
        while fresh.any():
            front = [int(fresh.argmax())]
            fresh[front[0]] = False
            while front:
                top = front.pop()
                found = np.flatnonzero(link[top] & fresh)
                fresh[found] = False
                a.append(np.full(len(found), node[top]))
                b.append(node[found])
                front.extend(found.tolist())
        empty = np.empty(0, np.int64)
        return [np.concatenate([empty, *a]), np.concatenate([empty, *b])]

    return kernel


def counter(least: float) -> Callable:
    """Linked vectors of each node in the other side, or within one block, copies counted."""
    def kernel(node: np.ndarray, weight: np.ndarray, side: np.ndarray, same: bool, x: np.ndarray) -> list:
        link = x @ x.T >= least
        if not same:
            link &= side[:, None] != side[None, :]
        np.fill_diagonal(link, False)
        return [node, link @ weight]

    return kernel


def near_duplicates(
    vectors: DataFrame, least: float = 0.95, tables: int = TABLES, groups: int = GROUPS, probes: int = PROBES,
    scale: float = SCALE, seed: int = 5, block: int = BLOCK, vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """vec_id, n_links, component_id (the smallest id reachable by links) and kept (is it its own) of every row.

    Links are pairs with a cosine of at least `least`. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, and vectors of different length don't link. Equal vectors link
    with each other; rows with the same id are vectors of their own, and keep that id.
    """
    v = F.col("v")
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    fine = (
        v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    good = F.coalesce(fine, F.lit(False))
    distinct = kept(
        rows.where(good).groupBy("v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("weight"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    entered = kept(emit_cells(distinct, tables, groups, probes, scale, seed))
    shared = entered.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    candidates = entered.join(shared, "key").join(distinct, "node").withColumnRenamed("key", "grp")
    edges = in_blocks(candidates, "size", block, forest(least), "a bigint, b bigint").distinct()
    roots_of = kept(components(edges))
    sizes = roots_of.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    members = roots_of.join(sizes, "component").join(distinct, "node").withColumnRenamed("component", "grp")
    counts = in_blocks(members, "size", block, counter(least), "node bigint, links bigint").groupBy("node").agg(
        F.sum("links").alias("links"))
    least_id = roots_of.join(distinct, "node").groupBy("component").agg(F.min("first").alias("component_id"))
    by_node = (
        distinct.join(roots_of.join(least_id, "component"), "node", "left").join(counts, "node", "left")
        .select("v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                F.coalesce("component_id", "first").alias("component_id"))
    )
    linked = rows.where(good).join(by_node, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
