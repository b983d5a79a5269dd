"""What several operators share: reading, word patterns, checkpoints, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.session import ensure_checkpoint_dir

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column) -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(text.cast("string"), F.lit(""))


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """The table itself; from now on its session hands rows to Python in batches of at most so many.

    Ten thousand whole texts, Spark's default, take hundreds of megabytes on both sides of the pipe.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    return df


def kept(df: DataFrame) -> DataFrame:
    """The table written to the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same as `kept`, as a Parquet table in that folder: smaller, where rows are many or hold texts."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph.

    edges: columns a, b (long). Returns node, component (the smallest node reachable), one row per node
    that has an edge to another node. Self loops, nulls and repeated edges are allowed and ignored.

    Each round links every node's larger neighbours to its smallest one and then every node's smaller
    neighbours likewise (large star, small star); rows of a node are only aggregated or joined with the
    node's minimum, so a node with very many edges is never gathered. The graph stays in the checkpoint
    folder between rounds.
    """
    both = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")).alias("h"))
    now = kept(both.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before = now.agg(mark.alias("x")).first()["x"]
    for _ in range(rounds):
        out = F.explode(F.array(F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")),
                                F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")))).alias("e")
        around = now.select(out).select("e.u", "e.v")
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Both sides are dealt by the node anyway; merged, they need no further job that broadcasts one of them.
        large = (around.where("v > u").join(least.hint("merge"), "u").where("v <> m")
                 .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(small.hint("merge"), "hi")
        after = kept(
            joined.select(F.explode(F.array(
                F.struct("hi", F.col("m").alias("lo")),
                F.struct(F.greatest("lo", "m").alias("hi"), F.least("lo", "m").alias("lo")),
            )).alias("e")).select("e.*").where("hi <> lo").distinct()
        )
        # Both steps keep the components, so the graph is final once every node has one edge, to its root.
        found = after.agg(mark.alias("x")).first()["x"]
        now, done, before = after, found == before, found
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select("lo").distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        roots.select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    )
