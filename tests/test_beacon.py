"""Beacon factors, spectrum and candidates against small inputs and a numpy brute force."""

import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from netquarry.operators import beacon, beacon_scan
from netquarry.operators.beacon import BeaconSpec
from netquarry.operators.spectral import spectrum_score

BASE = 1_700_000_000.0
CONN = "capture_id string, ts double, orig_h string, resp_h string, resp_p int, orig_bytes bigint"


def conn(spark, *groups):
    """Each group: (capture, src, dst, port, times, bytes)."""
    rows = [
        (cap, float(t), src, dst, port, int(b))
        for cap, src, dst, port, times, size in groups
        for t, b in zip(times, size if isinstance(size, (list, np.ndarray)) else [size] * len(times))
    ]
    return spark.createDataFrame(rows, CONN)


def regular(n, step, base=BASE):
    return [base + i * step for i in range(n)]


def brute_force(times, sizes, spec=BeaconSpec()):
    """Factors and score of one pair, step by step in numpy."""
    t = np.sort(np.asarray(times, dtype=float))
    gaps = np.diff(t)
    gaps = gaps[gaps <= spec.max_gap_secs]
    if len(t) < spec.min_rows or len(gaps) < spec.min_gaps:
        return None

    def even(x):
        return min(1.0, max(0.0, 1.0 - np.std(x) / np.mean(x)))

    median = np.median(gaps)
    parts = {
        "interval_score": even(gaps) if gaps.mean() > 0 else 0.0,
        "size_score": even(sizes) if np.mean(sizes) > 0 else 0.5,
        "freq_score": float(np.mean(np.abs(gaps - median) <= median * spec.freq_tolerance * (1 + 1e-12))) if median > 0 else 0.0,
        "persist_score": min(1.0, (t[-1] - t[0]) / spec.persist_norm_secs),
    }
    values = list(parts.values())
    mean = 0.0 if min(values) <= 0 else math.exp(sum(map(math.log, values)) / 4)
    period, score = spectrum_score(gaps)
    return parts | {
        "modal_interval_secs": median, "interval_jitter_secs": np.std(gaps), "geomean": mean,
        "spectral_score": score, "spectral_period_secs": period,
        "composite_score": min(1.0, mean + score * spec.spectral_weight),
    }


def own_series():
    """Series of many kinds: steady, drifting, bursts, two clocks, pauses longer than the limit, a ramp of sizes."""
    rng = np.random.default_rng(31)
    count = rng.integers(10, 90, 12)
    count[[2, 7]] = 9, 6
    kinds = (
        lambda n: np.full(n, 17.0),
        lambda n: 40 + np.arange(n) * 1.5,
        lambda n: np.where(np.arange(n) % 7 == 0, 900.0, 2.0),
        lambda n: np.where(rng.random(n) < 0.5, 11.0, 29.0),
        lambda n: np.where(np.arange(n) % 9 == 4, 4000.0, 75.0),
        lambda n: rng.exponential(300, n),
    )
    out = {}
    for k, n in enumerate(count):
        times = BASE + np.cumsum(kinds[k % len(kinds)](int(n)))
        sizes = (rng.integers(0, 2, len(times)) * 500, np.arange(len(times)) * 13 + 1, np.zeros(len(times)))[k % 3]
        out[k] = (times, sizes.astype(int))
    return out


def test_own_series_equal_brute_force(spark):
    series = own_series()
    table = conn(spark, *[("c", f"10.1.0.{k}", "9.9.9.9", 8080, t, b) for k, (t, b) in series.items()])
    got = {r.src: r for r in beacon.beacon_scores(beacon.internal_to_external(table), BeaconSpec(threshold=0.0)).collect()}
    want = {f"10.1.0.{k}": brute_force(t, b) for k, (t, b) in series.items()}
    assert set(got) == {k for k, v in want.items() if v is not None} and len(got) < len(want)
    for src, row in got.items():
        for name in SCORE_COLUMNS:
            assert row[name] == pytest.approx(want[src][name], rel=1e-6, abs=1e-6), (src, name)


def test_candidates_are_the_best_scores_rounded(spark):
    series = own_series()
    table = conn(spark, *[("c", f"10.1.0.{k}", "9.9.9.9", 8080, t, b) for k, (t, b) in series.items()])
    flows = beacon.internal_to_external(table)
    spec = BeaconSpec(threshold=0.0, top_n=4)
    best = sorted(beacon.beacon_scores(flows, spec).collect(), key=lambda r: (-r.composite_score, r.src))[:4]
    rows = beacon.beacon_candidates(flows, spec).orderBy("position").collect()
    assert [(r.position, r.src, r.composite_score) for r in rows] == [
        (i + 1, r.src, round(r.composite_score, 3)) for i, r in enumerate(best)]


@pytest.mark.parametrize("length", range(0, 8))
def test_short_sequences_have_no_spectrum(length):
    assert spectrum_score(np.random.default_rng(length).exponential(5, length)) == (0.0, 0.0)


def test_a_sine_of_gaps_has_its_period():
    gaps = 100 + 30 * np.sin(2 * np.pi * np.arange(400) / 20)
    period, score = spectrum_score(gaps)
    assert score == 1.0 and period == pytest.approx(2000, rel=0.05)


def test_which_ends_count(spark):
    rng = np.random.default_rng(3)
    ends = ["10.0.0.1", "10.0.0.2", "172.20.1.1", "8.8.4.4", "1.0.0.1"]
    groups = [("c", a, b, 1, BASE + np.cumsum(rng.exponential(9, 3)), 5) for a in ends for b in ends if a != b]
    table = conn(spark, *groups)
    listed = spark.createDataFrame([("c", "10.0.0.1", True), ("c", "8.8.4.4", True), ("c", "1.0.0.1", False)],
                                   "capture_id string, ip string, is_internal boolean")
    def pairs(df):
        return {(r.src, r.dst) for r in df.select("src", "dst").distinct().collect()}

    inside = {"10.0.0.1", "8.8.4.4"}
    assert pairs(beacon.outbound_flows(table, hosts=listed)) == {(a, b) for a in inside for b in ends if b not in inside}
    assert pairs(beacon.outbound_flows(table, hosts=listed, cidrs=["172.16.0.0/12"])) == pairs(beacon.outbound_flows(table, hosts=listed))
    assert pairs(beacon.outbound_flows(table, cidrs=["172.16.0.0/12", "nonsense"])) == {("172.20.1.1", b) for b in ends if b != "172.20.1.1"}
    private = set(ends[:3])
    assert pairs(beacon.internal_to_external(table)) == {(a, b) for a in private for b in ends if b not in private}


def test_empty_and_incomplete_tables(spark):
    assert beacon.beacon_factors(beacon.outbound_flows(conn(spark))).count() == 0
    partial = spark.createDataFrame([("c", "10.0.0.1", "1.2.3.4")], "capture_id string, src string, dst string")
    assert beacon.outbound_flows(partial).count() == 0


def test_captures_do_not_mix(spark):
    times = regular(16, 60.0)
    table = conn(
        spark,
        ("a", "10.0.0.1", "1.2.3.4", 443, times[::2], 100),
        ("b", "10.0.0.1", "1.2.3.4", 443, times[1::2], 100),
    )
    assert beacon.beacon_factors(beacon.internal_to_external(table)).count() == 0


def messy_pairs(seed=5):
    """Pairs with pauses, repeated times, jitter and alternating gaps."""
    rng = np.random.default_rng(seed)
    pairs = {}
    pairs[1] = BASE + np.cumsum(rng.normal(60, 3, 200).clip(1))
    pairs[2] = BASE + np.cumsum(np.tile([30.0, 90.0], 60))
    pairs[3] = BASE + np.cumsum(np.where(rng.random(150) < 0.05, 5000.0, rng.normal(45, 2, 150)))
    pairs[4] = np.repeat(BASE + np.cumsum(rng.integers(50, 70, 60)), rng.integers(1, 4, 60)).astype(float)
    pairs[5] = BASE + np.cumsum(60 + 20 * np.sin(np.arange(180) / 5) + rng.normal(0, 1, 180))
    pairs[6] = np.full(40, BASE)
    sizes = {k: rng.integers(80, 140, len(v)) for k, v in pairs.items()}
    return pairs, sizes


SCORE_COLUMNS = (
    "interval_score", "size_score", "freq_score", "persist_score", "modal_interval_secs", "interval_jitter_secs",
    "geomean", "spectral_score", "spectral_period_secs", "composite_score",
)


@pytest.mark.parametrize("piece_rows", [10_000, 110, 5])
def test_scores_equal_brute_force_by_both_ways(spark, piece_rows):
    pairs, sizes = messy_pairs()
    table = conn(spark, *[("c", f"10.0.0.{k}", "1.2.3.4", 443, t, sizes[k]) for k, t in pairs.items()])
    spec = BeaconSpec(threshold=0.0, piece_rows=piece_rows)
    got = {r.src: r for r in beacon.beacon_scores(beacon.internal_to_external(table), spec).collect()}
    want = {f"10.0.0.{k}": brute_force(t, sizes[k]) for k, t in pairs.items()}
    assert set(got) == {k for k, v in want.items() if v is not None}
    for src, expected in want.items():
        for name in SCORE_COLUMNS:
            assert got[src][name] == pytest.approx(expected[name], rel=1e-6, abs=1e-6), (src, name)


def test_factors_are_equal_by_both_ways(spark):
    pairs, sizes = messy_pairs()
    table = conn(spark, *[("c", f"10.0.0.{k}", "1.2.3.4", 443, t, sizes[k]) for k, t in pairs.items()])
    flows = beacon.internal_to_external(table)
    a = beacon.beacon_factors(flows, BeaconSpec()).orderBy("src").toPandas().round(6)
    b = beacon.beacon_factors(flows, BeaconSpec(piece_rows=10)).orderBy("src").toPandas().round(6)
    pd.testing.assert_frame_equal(a, b)


def test_a_burst_of_one_pair_is_dealt_evenly(spark):
    rng = np.random.default_rng(4)
    spec = BeaconSpec(piece_rows=1000)
    # 99 % of the pair's rows in ten minutes of a month, a tenth of them at one time; and many small pairs.
    burst = np.concatenate([BASE + rng.random(17_820) * 600, np.full(1_980, BASE + 300.0), BASE + rng.random(200) * 30 * 86400])
    small = [("c", f"10.0.1.{k}", "1.2.3.4", 443, BASE + rng.random(20) * 86400, np.full(20, 100)) for k in range(100)]
    table = conn(spark, ("c", "10.0.0.1", "1.2.3.4", 443, burst, rng.integers(80, 140, len(burst))), *small)
    flows = beacon.internal_to_external(table)
    rows = [r["count"] for r in beacon_scan.dealt(flows, spec).groupBy("slice").count().collect()]
    assert len(rows) == 4 and max(rows) < 1.5 * sum(rows) / 4
    assert not beacon.fits(flows, spec) and beacon.fits(flows, BeaconSpec())
    a = beacon.beacon_factors(flows, spec).orderBy("src").toPandas().round(6)
    b = beacon.beacon_factors(flows, BeaconSpec()).orderBy("src").toPandas().round(6)
    pd.testing.assert_frame_equal(a, b)


def test_spectral_pruning_keeps_every_candidate(spark):
    pairs, sizes = messy_pairs(9)
    table = conn(spark, *[("c", f"10.0.0.{k}", "1.2.3.4", 443, t, sizes[k]) for k, t in pairs.items()])
    flows = beacon.internal_to_external(table)
    kept = {r.src for r in beacon.beacon_scores(flows, BeaconSpec()).collect()}
    every = beacon.beacon_scores(flows, replace(BeaconSpec(), threshold=0.0))
    assert kept == {r.src for r in every.where(F.col("composite_score") >= 0.5).collect()}


def test_external_scores(spark):
    rows = [("c", 0.9, "a", "b"), ("c", 0.5, "a", "c"), ("c", 0.2, "a", "d"), ("d", 0.1, "a", "b")]
    table = spark.createDataFrame(rows, "capture_id string, score double, src_ip string, dst_ip string")
    got = {r.capture_id: r for r in beacon.external_beacon_signals(table).collect()}
    assert got["c"].rita_top_beacon_score == 0.9 and got["c"].rita_beacon_pairs == 2
    assert got["d"].rita_beacon_pairs == 0
    assert [r.dst_ip for r in beacon.top_external_beacons(table, 1).where("capture_id = 'c'").collect()] == ["b"]
