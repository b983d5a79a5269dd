"""Spectral score of gap sequences too long for one task.

The same steps as in ``spectral``, spread over the cluster: running sums by time slice,
interpolation on the even grid piece by piece, and a Fourier transform of any length n as
a convolution of power-of-two length (Bluestein), computed as a matrix of short
transforms (four-step method). A task never holds more than about 2 * sqrt(n) values.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Grid points written by one row of the interpolation; longer pieces are cut and spread.
PIECE = 65536


def gap_nodes(runs: DataFrame, spec) -> tuple[DataFrame, DataFrame]:
    """(nodes, sequences): the usable gaps in time order on their cumulative clock.

    A node is one distinct time: ``enter`` is its gap, ``leave`` the gap of its last row,
    which is 0 for repeated times. ``next_*`` describe the node that follows.
    """
    pair, by_slice = spec.pair, [*spec.pair, "slice"]
    usable = F.coalesce(F.col("gap") <= spec.max_gap_secs, F.lit(False))
    entries = usable.cast("bigint") + F.col("c") - 1
    rows = runs.select(
        *by_slice, "ts",
        entries.alias("entries"),
        F.when(usable, F.col("gap")).otherwise(0.0).alias("enter"),
        F.when(F.col("c") > 1, 0.0).otherwise(F.col("gap")).alias("leave"),
    ).where("entries > 0")
    in_slice = Window.partitionBy(*by_slice).orderBy("ts")
    over_slices = Window.partitionBy(*pair).orderBy("slice")
    earlier = over_slices.rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        rows.groupBy(*by_slice)
        .agg(
            F.sum("enter").alias("slice_time"),
            F.sum("entries").alias("slice_entries"),
            F.min_by("enter", "ts").alias("slice_enter"),
        )
        .withColumn("offset", F.coalesce(F.sum("slice_time").over(earlier), F.lit(0.0)))
        .withColumn("border_clock", F.lead(F.col("offset") + F.col("slice_enter")).over(over_slices))
        .withColumn("border_enter", F.lead("slice_enter").over(over_slices))
    )
    running = in_slice.rowsBetween(Window.unboundedPreceding, 0)
    timed = rows.withColumn("local", F.sum("enter").over(running)).join(
        slices.select(*by_slice, "offset", "border_clock", "border_enter"), by_slice
    )
    timed = timed.withColumn("clock", F.col("offset") + F.col("local"))
    nodes = timed.select(
        *pair, "clock", "enter", "leave",
        F.coalesce(F.lead("clock").over(in_slice), "border_clock").alias("next_clock"),
        F.coalesce(F.lead("enter").over(in_slice), "border_enter").alias("next_enter"),
        "slice", "ts",
    )
    lengths = slices.groupBy(*pair).agg(F.sum("slice_entries").alias("n"))
    ends = nodes.groupBy(*pair).agg(F.min("clock").alias("t0"), F.max("clock").alias("t1"))
    # The number is for good once the table is written.
    sequences = lengths.join(ends, pair).withColumn("pair_id", F.monotonically_increasing_id())
    sequences = sequences.withColumn("dt", (F.col("t1") - F.col("t0")) / (F.col("n") - 1)).where("dt > 0")
    return nodes, sequences


def even_samples(nodes: DataFrame, sequences: DataFrame, spec) -> DataFrame:
    """(pair_id, k, x): the gap function on the even grid, k = 0 .. n - 1."""
    rows = nodes.join(sequences, spec.pair)

    def grid_from(clock: str):
        return F.ceil((F.col(clock) - F.col("t0")) / F.col("dt")).cast("bigint")

    last = F.col("next_clock").isNull()
    first_k = F.when(last, F.col("n") - 1).otherwise(grid_from("clock"))
    last_k = F.when(last, F.col("n") - 1).otherwise(F.least(grid_from("next_clock") - 1, F.col("n") - 2))
    pieces = (
        rows.withColumn("k0", first_k)
        .withColumn("k1", last_k)
        .where("k1 >= k0")
        .withColumn("piece", F.explode(F.sequence(F.expr(f"k0 DIV {PIECE}"), F.expr(f"k1 DIV {PIECE}"))))
    )
    # A long pause on a fine grid yields many points from one node; spread its pieces.
    pieces = pieces.repartition("pair_id", "piece")
    k = F.explode(
        F.sequence(
            F.greatest("k0", F.col("piece") * PIECE), F.least("k1", F.col("piece") * PIECE + (PIECE - 1))
        )
    )
    points = pieces.select("pair_id", "t0", "dt", "clock", "leave", "next_clock", "next_enter", k.alias("k"))
    at = F.col("t0") + F.col("k") * F.col("dt")
    part = (at - F.col("clock")) / (F.col("next_clock") - F.col("clock"))
    inner = F.col("leave") + (F.col("next_enter") - F.col("leave")) * part
    return points.select(
        "pair_id", "k", F.when(F.col("next_clock").isNull(), F.col("leave")).otherwise(inner).alias("x")
    )


def chirp_phase(index: np.ndarray, n: int) -> np.ndarray:
    """index^2 mod 2n, without overflow of 64-bit integers."""
    period = 2 * n
    index = index.astype(np.int64)
    high, low = index >> 16, index & 0xFFFF
    return ((((high * index) % period) << 16) % period + (low * index) % period) % period


def chirp(index: np.ndarray, n: int) -> np.ndarray:
    return np.exp(-1j * np.pi * chirp_phase(index, n) / n)


def column_step(pdf: pd.DataFrame) -> pd.DataFrame:
    """Column n2 of signal and chirp matrices: short transforms and twiddle factors."""
    pair_id, n2 = int(pdf["pair_id"].iloc[0]), int(pdf["n2"].iloc[0])
    n, rows, cols = (int(pdf[c].iloc[0]) for c in ("n", "rows", "cols"))
    total = rows * cols
    k = pdf["k"].to_numpy()
    signal = np.zeros(rows, dtype=complex)
    signal[k // cols] = pdf["x"].to_numpy() * chirp(k, n)
    index = np.arange(rows, dtype=np.int64) * cols + n2
    mirrored = np.minimum(index, total - index)
    kernel = np.where(mirrored < n, np.conj(chirp(mirrored, n)), 0)
    k1 = np.arange(rows, dtype=np.int64)
    twiddle = np.exp(-2j * np.pi * ((k1 * n2) % total) / total)
    a, b = np.fft.fft(signal) * twiddle, np.fft.fft(kernel) * twiddle
    return pd.DataFrame({
        "pair_id": pair_id, "n": n, "rows": rows, "cols": cols, "k1": k1, "n2": n2,
        "a_re": a.real, "a_im": a.imag, "b_re": b.real, "b_im": b.imag,
    })


def row_step(pdf: pd.DataFrame) -> pd.DataFrame:
    """Row k1: finish both transforms, multiply, and begin the inverse one."""
    pdf = pdf.sort_values("n2")
    pair_id, k1 = int(pdf["pair_id"].iloc[0]), int(pdf["k1"].iloc[0])
    n, rows, cols = (int(pdf[c].iloc[0]) for c in ("n", "rows", "cols"))
    a = np.fft.fft(pdf["a_re"].to_numpy() + 1j * pdf["a_im"].to_numpy())
    b = np.fft.fft(pdf["b_re"].to_numpy() + 1j * pdf["b_im"].to_numpy())
    j1 = np.arange(cols, dtype=np.int64)
    total = rows * cols
    c = np.fft.ifft(a * b) * np.exp(2j * np.pi * ((j1 * k1) % total) / total)
    return pd.DataFrame({
        "pair_id": pair_id, "n": n, "rows": rows, "cols": cols, "j1": j1, "k1": k1,
        "re": c.real, "im": c.imag,
    })


def inverse_step(pdf: pd.DataFrame) -> pd.DataFrame:
    """Inverse column j1: magnitudes of the frequencies 1 .. n / 2 it holds."""
    pdf = pdf.sort_values("k1")
    n, rows, cols = (int(pdf[c].iloc[0]) for c in ("n", "rows", "cols"))
    values = np.fft.ifft(pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy())
    index = int(pdf["j1"].iloc[0]) + cols * np.arange(rows, dtype=np.int64)
    keep = (index >= 1) & (index <= n // 2)
    return pd.DataFrame({
        "pair_id": int(pdf["pair_id"].iloc[0]), "index": index[keep], "magnitude": np.abs(values[keep]),
    })


SIZES = "pair_id bigint, n bigint, rows bigint, cols bigint"


def magnitudes(samples: DataFrame, sequences: DataFrame) -> DataFrame:
    """(pair_id, index, magnitude) of the frequencies above zero."""
    level = samples.groupBy("pair_id").agg(
        F.avg("x").alias("mean"), (F.max("x") > F.min("x")).alias("varies")
    )
    bits = F.ceil(F.log2(2 * F.col("n") - 1))
    shape = sequences.select("pair_id", "n", bits.alias("bits")).select(
        "pair_id", "n",
        F.expr("shiftleft(1L, CAST(bits DIV 2 AS INT))").alias("rows"),
        F.expr("shiftleft(1L, CAST(bits - bits DIV 2 AS INT))").alias("cols"),
    )
    plan = level.where("varies").join(shape, "pair_id")
    placed = samples.join(plan, "pair_id").select(
        "pair_id", "n", "rows", "cols", "k", (F.col("k") % F.col("cols")).alias("n2"),
        (F.col("x") - F.col("mean")).alias("x"),
    )
    columns = placed.groupBy("pair_id", "n2").applyInPandas(
        column_step, f"{SIZES}, k1 bigint, n2 bigint, a_re double, a_im double, b_re double, b_im double"
    )
    rows = columns.groupBy("pair_id", "k1").applyInPandas(
        row_step, f"{SIZES}, j1 bigint, k1 bigint, re double, im double"
    )
    return rows.groupBy("pair_id", "j1").applyInPandas(
        inverse_step, "pair_id bigint, index bigint, magnitude double"
    )


def spectra(runs: DataFrame, spec, weighted_median: Callable) -> DataFrame:
    """(pair, period, score) of oversized pairs."""
    nodes, sequences = gap_nodes(runs, spec)
    sequences = sequences.checkpoint()
    samples = even_samples(nodes, sequences, spec).checkpoint()
    spectrum = magnitudes(samples, sequences).checkpoint()
    peaks = spectrum.groupBy("pair_id").agg(
        F.max(F.struct("magnitude", (-F.col("index")).alias("low"))).alias("top")
    ).select("pair_id", F.col("top.magnitude").alias("peak"), (-F.col("top.low")).alias("best"))
    others = spectrum.join(peaks, "pair_id").where("index <> best").withColumn("w", F.lit(1).cast("bigint"))
    background = weighted_median(others, ["pair_id"], "magnitude", "w").withColumnRenamed("median", "background")
    found = sequences.join(peaks, "pair_id").join(background, "pair_id")
    clear = F.expr("background > 0") & (F.col("peak") >= spec.noise_ratio * F.col("background"))
    ratio = F.col("peak") / (F.col("background") + 1e-9)
    score = (ratio - spec.noise_ratio) / (spec.full_ratio - spec.noise_ratio)
    return found.select(
        *spec.pair,
        F.when(clear, F.col("n") * F.col("dt") / F.col("best")).otherwise(0.0).alias("period"),
        F.when(clear, F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))).otherwise(0.0).alias("score"),
    )


# Ship this module inside the task, so that workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
