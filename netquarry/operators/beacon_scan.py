"""Beacon statistics by a segmented scan, for tables with pairs too large for one task.

Rows are dealt by ranges of (pair, time), which Spark cuts by a sample into even parts: a pair
of any size, and any burst of it, spreads over as many parts as its rows fill, and many small
pairs share one. Lags are taken within a part; the first row of a pair in a part gets its lag
from a table of the parts' last times. All else is a sum over (pair, gap), or an exact median
found by narrowing down a histogram. Nothing is sampled or cut, so the numbers equal those of
the ordinary way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.operators import spectral_hot
from netquarry.session import ensure_checkpoint_dir

# Histogram steps per doubling of a value: a bucket spans 0.017 percent.
BUCKETS_PER_OCTAVE = 4096


def weighted_median(values: DataFrame, key: list[str], value: str, weight: str) -> DataFrame:
    """Exact median of non-negative values with multiplicities, per key.

    Buckets are in value order. Their counts show which one or two hold the middle ranks;
    only the values of those are ranked one by one.
    """
    bucket = F.when(F.col(value) > 0, F.floor(F.log2(value) * BUCKETS_PER_OCTAVE)).otherwise(
        F.lit(-(2**40))
    )
    rows = values.select(*key, value, weight, bucket.cast("bigint").alias("bucket"))
    ordered = Window.partitionBy(*key).orderBy("bucket")
    running = ordered.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*key)
    ranks = (
        rows.groupBy(*key, "bucket")
        .agg(F.sum(weight).alias("n"))
        .withColumn("below", F.sum("n").over(running) - F.col("n"))
        .withColumn("total", F.sum("n").over(whole))
        .withColumn("low", F.expr("(total - 1) DIV 2"))
        .withColumn("high", F.expr("total DIV 2"))
    )
    holds = "(low >= {0} AND low < {0} + {1}) OR (high >= {0} AND high < {0} + {1})"
    wanted = ranks.where(holds.format("below", "n")).select(*key, "bucket", "below", "low", "high")
    inside = Window.partitionBy(*key, "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        rows.join(wanted, [*key, "bucket"])
        .groupBy(*key, "bucket", "below", "low", "high", value)
        .agg(F.sum(weight).alias("w"))
        .withColumn("start", F.col("below") + F.sum("w").over(inside) - F.col("w"))
    )

    def at(rank: str):
        return F.max(F.when(F.expr(f"{rank} >= start AND {rank} < start + w"), F.col(value)))

    return ranked.groupBy(*key).agg(((at("low") + at("high")) / 2).alias("median"))


def dealt(flows: DataFrame, spec) -> DataFrame:
    """Flows with the number of their part (slice), written once: the numbers come from a sample.

    Rows that are alike but for their size are spread by it.
    """
    ensure_checkpoint_dir(flows.sparkSession)
    parts = int(flows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*spec.pair, "ts", F.xxhash64("ts", "orig_bytes")]
    return flows.repartitionByRange(parts, *order).withColumn("slice", F.spark_partition_id()).checkpoint()


def time_runs(flows: DataFrame, spec) -> DataFrame:
    """Distinct times of each pair and part with their row count and the gap before them.

    Written once, as several sums follow.
    """
    pair, by_slice = spec.pair, [*spec.pair, "slice"]
    times = dealt(flows, spec).repartition(*by_slice).groupBy(*by_slice, "ts").agg(F.count("*").alias("c"))
    # One row for each pair of a part.
    last = times.groupBy(*by_slice).agg(F.max("ts").alias("slice_end"))
    earlier = F.lag("slice_end").over(Window.partitionBy(*pair).orderBy("slice"))
    borders = last.select(*by_slice, earlier.alias("before_slice")).where("before_slice IS NOT NULL")
    before = F.lag("ts").over(Window.partitionBy(*by_slice).orderBy("ts"))
    runs = times.withColumn("prev", before).join(borders, by_slice, "left")
    return runs.select(*by_slice, "ts", "c", (F.col("ts") - F.coalesce("prev", "before_slice")).alias("gap")).checkpoint()


def gap_counts(runs: DataFrame, spec) -> DataFrame:
    """Distinct usable gaps of each pair with their number."""
    one = F.lit(1).cast("bigint")
    steps = F.array(
        F.struct(F.col("gap").alias("gap"), one.alias("c")),
        F.struct(F.lit(0.0).alias("gap"), (F.col("c") - 1).alias("c")),
    )
    return (
        runs.select(*spec.pair, F.inline(steps))
        .where((F.col("gap") <= spec.max_gap_secs) & (F.col("c") > 0))
        .groupBy(*spec.pair, "gap")
        .agg(F.sum("c").alias("c"))
    )


def factors(
    flows: DataFrame, runs: DataFrame, spec, factor_columns: Callable[..., list[Column]],
    in_tolerance: Callable[..., Column],
) -> DataFrame:
    """Factors of every pair with enough rows and gaps."""
    pair = spec.pair
    # Several passes follow over this table of distinct gaps, so it is written once.
    gaps = gap_counts(runs, spec).checkpoint()
    means = gaps.groupBy(*pair).agg(
        F.sum("c").alias("gap_count"), (F.sum(F.col("gap") * F.col("c")) / F.sum("c")).alias("gap_mean")
    )
    centres = means.join(weighted_median(gaps, pair, "gap", "c"), pair)
    near = F.when(in_tolerance(F.col("gap"), F.col("median"), spec), F.col("c")).otherwise(0)
    spread = F.sum(F.pow(F.col("gap") - F.col("gap_mean"), 2) * F.col("c")) / F.sum("c")
    around = gaps.join(centres, pair).groupBy(*pair).agg(
        F.max("gap_count").alias("gap_count"), F.max("gap_mean").alias("gap_mean"), F.max("median").alias("median"),
        F.sqrt(spread).alias("gap_sd"), F.sum(near).alias("in_bin"),
    )
    sizes = flows.groupBy(*pair).agg(
        F.count("*").alias("connection_count"),
        (F.max("ts") - F.min("ts")).alias("span"),
        F.avg("orig_bytes").alias("bytes_mean"),
        F.stddev_pop("orig_bytes").alias("bytes_sd"),
    )
    stats = sizes.join(around, pair).where(
        (F.col("connection_count") >= spec.min_rows) & (F.col("gap_count") >= spec.min_gaps)
    )
    return stats.select(*factor_columns(spec))


def scores(
    flows: DataFrame, spec, factor_columns: Callable[..., list[Column]], in_tolerance: Callable[..., Column],
    spectrum: Callable[..., Column],
) -> DataFrame:
    """Factors of the pairs near the threshold, with their spectral score.

    Gap sequences of up to ``piece_rows`` entries go to ``spectrum`` whole; longer ones are
    transformed in parts.
    """
    pair = spec.pair
    runs = time_runs(flows, spec)
    near = factors(flows, runs, spec, factor_columns, in_tolerance)
    near = near.where(F.col("geomean") >= spec.threshold - spec.spectral_weight).checkpoint()
    needed = near.where(F.col("gap_count") >= spec.min_spectral_gaps)
    short = needed.where(F.col("gap_count") <= spec.piece_rows).select(*pair)
    usable = F.when(F.col("gap") <= spec.max_gap_secs, F.array("gap")).otherwise(F.array().cast("array<double>"))
    entries = F.concat(usable, F.array_repeat(F.lit(0.0), (F.col("c") - 1).cast("int")))
    own = F.array_sort(F.collect_list(F.struct("ts", "slice", entries.alias("gaps"))))
    listed = runs.join(short, pair, "left_semi").groupBy(*pair).agg(F.flatten(F.transform(own, lambda r: r["gaps"])).alias("gaps"))
    spectra = listed.withColumn("s", spectrum(F.col("gaps"))).select(*pair, "s.period", "s.score")
    long = needed.where(F.col("gap_count") > spec.piece_rows).select(*pair)
    if not long.isEmpty():
        spectra = spectra.unionByName(
            spectral_hot.spectra(runs.join(long, pair, "left_semi"), spec, weighted_median).select(*pair, "period", "score"))
    zero = F.lit(0.0)
    return near.join(spectra, pair, "left").select(
        *near.columns,
        F.coalesce("period", zero).alias("spectral_period_secs"),
        F.coalesce("score", zero).alias("spectral_score"),
    )
