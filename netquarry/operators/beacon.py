"""Beacon scoring of (source, destination, port) pairs.

Where every pair is small enough for a task, one exchange by pair serves: sort by time, lag,
aggregate. Where one has more than ``piece_rows`` rows, all pairs go through a segmented scan
instead (see ``beacon_scan``), which deals rows by range of pair and time, so that tasks are
even whatever the pairs' sizes. Both ways give the same numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.functions.lists import INTERNAL_RANGES
from netquarry.functions.net import in_networks
from netquarry.functions.score import clamp01, geomean
from netquarry.operators import beacon_scan, spectral
from netquarry.operators.common import CAPTURE, internal_rows, not_internal_rows, top_k
from netquarry.schemas import FLOW_SCHEMA


@dataclass(frozen=True)
class BeaconSpec:
    """Fixed values of the scoring, all of them changeable."""

    keys: tuple[str, ...] = ("src", "dst", "port")
    min_rows: int = 10
    min_gaps: int = 2
    max_gap_secs: float = 3600.0
    persist_norm_secs: float = 4 * 3600.0
    freq_tolerance: float = 0.10
    noise_ratio: float = 3.0
    full_ratio: float = 10.0
    min_spectral_gaps: int = 8
    spectral_weight: float = 0.10
    threshold: float = 0.50
    top_n: int = 20
    # Rows of a pair that a task may hold at once; without influence on results.
    piece_rows: int = 1_000_000

    @property
    def pair(self) -> list[str]:
        return [CAPTURE, *self.keys]


FACTOR_COLUMNS = (
    "connection_count", "gap_count", "modal_interval_secs", "interval_jitter_secs",
    "avg_bytes_orig", "duration_secs", "interval_score", "size_score", "freq_score",
    "persist_score", "geomean",
)


def outbound_flows(
    conn: DataFrame, hosts: DataFrame | None = None, cidrs: list[str] | None = None
) -> DataFrame:
    """Connections as flows, kept when the source is internal and the destination is not.

    ``hosts`` (capture_id, ip, is_internal) takes precedence over ``cidrs``; with neither
    every flow is kept. A table without the needed columns gives no rows.
    """
    if not {"ts", "orig_h", "resp_h", "resp_p"} <= set(conn.columns):
        return conn.sparkSession.createDataFrame([], FLOW_SCHEMA)
    size = F.col("orig_bytes").try_cast("double") if "orig_bytes" in conn.columns else F.lit(0.0)
    flows = conn.select(
        CAPTURE,
        F.col("orig_h").alias("src"),
        F.col("resp_h").alias("dst"),
        F.coalesce(F.col("resp_p").try_cast("int"), F.lit(0)).alias("port"),
        F.col("ts").try_cast("double").alias("ts"),
        F.coalesce(size, F.lit(0.0)).alias("orig_bytes"),
    ).where("ts IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL")
    if hosts is not None:
        return not_internal_rows(internal_rows(flows, "src", hosts), "dst", hosts)
    if cidrs is not None:
        return flows.where(in_networks(F.col("src"), cidrs) & ~in_networks(F.col("dst"), cidrs))
    return flows


def internal_to_external(conn: DataFrame) -> DataFrame:
    return outbound_flows(conn, cidrs=list(INTERNAL_RANGES))


def evenness(mean: Column, deviation: Column) -> Column:
    """One minus the coefficient of variation, within 0 and 1."""
    return clamp01(1 - deviation / mean)


def factor_columns(spec: BeaconSpec) -> list[Column]:
    """The four factors and their mean from the per-pair statistics."""
    interval = F.when(F.col("gap_mean") > 0, evenness(F.col("gap_mean"), F.col("gap_sd"))).otherwise(0.0)
    size = F.when(F.col("bytes_mean") > 0, evenness(F.col("bytes_mean"), F.col("bytes_sd"))).otherwise(0.5)
    share = F.when(F.col("median") > 0, F.col("in_bin") / F.col("gap_count")).otherwise(0.0)
    persist = F.least(F.lit(1.0), F.col("span") / spec.persist_norm_secs)
    return [
        *spec.pair,
        "connection_count",
        "gap_count",
        F.col("median").alias("modal_interval_secs"),
        F.col("gap_sd").alias("interval_jitter_secs"),
        F.col("bytes_mean").alias("avg_bytes_orig"),
        F.col("span").alias("duration_secs"),
        interval.alias("interval_score"),
        size.alias("size_score"),
        share.alias("freq_score"),
        persist.alias("persist_score"),
        geomean(interval, size, share, persist).alias("geomean"),
    ]


def in_tolerance(gap: Column, median: Column, spec: BeaconSpec) -> Column:
    tolerance = median * spec.freq_tolerance
    return (gap >= median - tolerance) & (gap <= median + tolerance)


def _cold_factors(flows: DataFrame, spec: BeaconSpec, keep_gaps: bool) -> DataFrame:
    """Factors of ordinary pairs: one exchange and one sort serve all steps.

    The median is a window value over the pair, so that every factor is a plain aggregate.
    """
    whole_pair = Window.partitionBy(*spec.pair)
    in_time = whole_pair.orderBy("ts")
    step = F.col("ts") - F.lag("ts").over(in_time)
    rows = flows.select(
        *spec.pair, "ts", "orig_bytes", step.alias("step"), F.row_number().over(in_time).alias("seq")
    )
    rows = rows.withColumn("gap", F.when(F.col("step") <= spec.max_gap_secs, F.col("step")))
    rows = rows.withColumn("median", F.percentile("gap", F.lit(0.5)).over(whole_pair))
    gaps = F.collect_list(F.when(F.col("gap").isNotNull(), F.struct("seq", "gap")))
    stats = rows.groupBy(*spec.pair).agg(
        F.count("*").alias("connection_count"),
        (F.max("ts") - F.min("ts")).alias("span"),
        F.avg("orig_bytes").alias("bytes_mean"),
        F.stddev_pop("orig_bytes").alias("bytes_sd"),
        F.count("gap").alias("gap_count"),
        F.avg("gap").alias("gap_mean"),
        F.stddev_pop("gap").alias("gap_sd"),
        F.max("median").alias("median"),
        F.count(F.when(in_tolerance(F.col("gap"), F.col("median"), spec), 1)).alias("in_bin"),
        *([gaps.alias("gaps")] if keep_gaps else []),
    )
    stats = stats.where(
        (F.col("connection_count") >= spec.min_rows) & (F.col("gap_count") >= spec.min_gaps)
    )
    return stats.select(*factor_columns(spec), *(["gaps"] if keep_gaps else []))


def pair_sizes(flows: DataFrame, spec: BeaconSpec) -> DataFrame:
    """Rows and time span per pair; combines on the map side."""
    return flows.groupBy(*spec.pair).agg(
        F.count("*").alias("n_rows"), F.min("ts").alias("t_first"), F.max("ts").alias("t_last")
    )


def pair_sizes_from_rollup(rollup: DataFrame) -> DataFrame:
    """The same from a connection reduction, for pairs of (source, destination, port)."""
    return rollup.where("first_ts IS NOT NULL").select(
        CAPTURE,
        F.col("orig_h").alias("src"),
        F.col("resp_h").alias("dst"),
        F.coalesce("resp_p", F.lit(0)).alias("port"),
        F.col("n").alias("n_rows"),
        F.col("first_ts").alias("t_first"),
        F.col("last_ts").alias("t_last"),
    )


def fits(flows: DataFrame, spec: BeaconSpec, sizes: DataFrame | None = None) -> bool:
    """Whether no pair has more than ``piece_rows`` rows; one number decides."""
    counts = pair_sizes(flows, spec) if sizes is None else sizes
    largest = counts.agg(F.max("n_rows").alias("n")).first()["n"]
    return largest is None or largest <= spec.piece_rows


def beacon_factors(
    flows: DataFrame, spec: BeaconSpec = BeaconSpec(), sizes: DataFrame | None = None
) -> DataFrame:
    """Unrounded factors of every pair with enough rows and gaps."""
    if fits(flows, spec, sizes):
        return _cold_factors(flows, spec, keep_gaps=False)
    return beacon_scan.factors(flows, beacon_scan.time_runs(flows, spec), spec, factor_columns, in_tolerance)


def beacon_scores(
    flows: DataFrame, spec: BeaconSpec = BeaconSpec(), sizes: DataFrame | None = None
) -> DataFrame:
    """Factors with the spectral bonus; pairs below the threshold are dropped.

    The bonus is at most ``spectral_weight``, so only pairs within that distance of the
    threshold need a spectrum. This is exact and spares nearly all Python work.
    """
    udf = spectral.spectrum_udf(spec.noise_ratio, spec.full_ratio)
    if fits(flows, spec, sizes):
        near = _cold_factors(flows, spec, keep_gaps=True)
        near = near.where(F.col("geomean") >= spec.threshold - spec.spectral_weight)
        needed = F.col("gap_count") >= spec.min_spectral_gaps
        in_order = F.transform(F.array_sort("gaps"), lambda g: g["gap"])
        scored = near.withColumn("spectrum", udf(F.when(needed, in_order))).select(
            *spec.pair, *FACTOR_COLUMNS,
            F.col("spectrum.period").alias("spectral_period_secs"),
            F.col("spectrum.score").alias("spectral_score"),
        )
    else:
        scored = beacon_scan.scores(flows, spec, factor_columns, in_tolerance, udf)
    bonus = F.col("spectral_score") * spec.spectral_weight
    return scored.withColumn(
        "composite_score", F.least(F.lit(1.0), F.col("geomean") + bonus)
    ).where(F.col("composite_score") >= spec.threshold)


def beacon_candidates(
    flows: DataFrame, spec: BeaconSpec = BeaconSpec(), sizes: DataFrame | None = None
) -> DataFrame:
    """Best pairs per capture, rounded for display.

    ``sizes`` (see pair_sizes) spares a pass over the flows when it is known already.
    """
    scores = top_k(
        beacon_scores(flows, spec, sizes),
        [CAPTURE],
        [F.desc("composite_score"), *[F.asc(k) for k in spec.keys]],
        spec.top_n,
        rank="position",
    )
    return scores.select(
        CAPTURE,
        "position",
        *spec.keys,
        "connection_count",
        F.round("modal_interval_secs", 2).alias("modal_interval_secs"),
        F.round("interval_jitter_secs", 2).alias("interval_jitter_secs"),
        F.round("avg_bytes_orig", 1).alias("avg_bytes_orig"),
        F.round(F.col("duration_secs") / 3600, 2).alias("duration_hours"),
        *[F.round(c, 3).alias(c) for c in ("interval_score", "size_score", "freq_score", "persist_score")],
        F.round("spectral_period_secs", 2).alias("spectral_period_secs"),
        F.round("composite_score", 3).alias("composite_score"),
    )


def beacon_signals(candidates: DataFrame) -> DataFrame:
    """Best score per capture as a signal."""
    return candidates.groupBy(CAPTURE).agg(F.max("composite_score").alias("beacon_top_score"))


def external_beacon_signals(beacons: DataFrame) -> DataFrame:
    """Signals from a table of externally computed beacon scores."""
    return beacons.groupBy(CAPTURE).agg(
        F.lit(True).alias("rita_available"),
        F.round(F.max("score"), 4).alias("rita_top_beacon_score"),
        F.count(F.when(F.col("score") >= 0.5, 1)).alias("rita_beacon_pairs"),
    )


def top_external_beacons(beacons: DataFrame, k: int = 20) -> DataFrame:
    order = [F.desc("score"), F.asc("src_ip"), F.asc("dst_ip")]
    return top_k(beacons, [CAPTURE], order, k, rank="position")


def infinite_gap_spec(**overrides) -> BeaconSpec:
    """A spec that keeps every gap, for event tables with long pauses."""
    return BeaconSpec(max_gap_secs=math.inf, **overrides)
