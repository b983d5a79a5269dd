"""Targets and copies against a plain computation."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from netquarry.llm import mixing


def waterfill(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > most * sizes[s]}
        if not over:
            target |= {s: share * weight[s] for s in open_}
            break
        target |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return target


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(4000):
        source = rng.choice(["a"] * 20 + ["b", "Z", "é", "😀", "", None] + ["c"] * 3)
        n = int(rng.lognormvariate(3, 1.2)) if source else 2
        out.append((i, " ".join("w" * 3 for _ in range(n)) if i % 50 else rng.choice([None, "", " \t\n"]), source))
    return out + [(9000, "same text", "a")] * 500 + [(i, "copy of it", "c") for i in range(9001, 10001)]


def test_targets_copies_and_closeness(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x"))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        assert r["size"] == len((r.text or "").split())
        sizes[r.source] += r["size"]
        taken[r.source] += r["size"] * r.copies
        largest[r.source] = max(largest[r.source], r["size"])
        assert 0 <= r.copies <= 3
    want = waterfill(sizes)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 * largest[s] + 3, s
    again = mixing.mix(df.repartition(7)).groupBy("doc_id").agg(F.sum("copies").alias("n"))
    first = mixing.mix(df).groupBy("doc_id").agg(F.sum("copies").alias("m"))
    assert again.join(first, "doc_id").where("n <> m").count() == 0


def test_the_mix_repeats_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    n = mixing.mix(df).agg(F.sum("copies")).first()[0]
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() == n


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (2, " ", "b")], [(1, "one", "a")]])
def test_small_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.target == r["size"] and (r.copies == 1 or r["size"] == 0)
