"""Beacon queries on the connection view.

Real gaps in the events table are hours long, so no gap is cut and a pair is
(source, port) over all days of one capture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.operators import beacon
from netquarry.plans import adapters
from netquarry.plans.catalog import query

SPEC = beacon.infinite_gap_spec(keys=("src", "port"), persist_norm_secs=30 * 86400.0)
OPEN_SPEC = beacon.infinite_gap_spec(
    keys=("src", "port"), persist_norm_secs=30 * 86400.0, threshold=0.0
)


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outbound flows with all days merged into one capture."""
    conn = adapters.conn(spark, sf_dir).withColumn("capture_id", F.lit("all"))
    return beacon.internal_to_external(conn)


FACTORS_SQL = f"""
WITH {adapters.CONN_SQL},
gaps AS (
  SELECT orig_h AS src, resp_p AS port, ts, orig_bytes,
         ts - lag(ts) OVER (PARTITION BY orig_h, resp_p ORDER BY ts) AS gap
  FROM conn),
stats AS (
  SELECT src, port, count(*) AS n, count(gap) AS g, median(gap) AS med, stddev_pop(gap) AS sd,
         avg(gap) AS mean_gap, avg(orig_bytes) AS mean_b, stddev_pop(orig_bytes) AS sd_b,
         max(ts) - min(ts) AS span
  FROM gaps GROUP BY src, port HAVING count(*) >= 10),
freq AS (
  SELECT s.src, s.port,
         avg(CASE WHEN k.gap BETWEEN s.med - s.med * 0.1 AND s.med + s.med * 0.1
                  THEN 1e0 ELSE 0e0 END) AS f
  FROM stats s JOIN gaps k ON k.src = s.src AND k.port = s.port AND k.gap IS NOT NULL
  GROUP BY s.src, s.port),
factors AS (
  SELECT s.*, greatest(0e0, least(1e0, 1 - sd / mean_gap)) AS i_s,
         CASE WHEN mean_b > 0 THEN greatest(0e0, least(1e0, 1 - sd_b / mean_b)) ELSE 0.5e0 END AS s_s,
         f AS f_s, least(1e0, span / (30 * 86400e0)) AS p_s
  FROM stats s JOIN freq USING (src, port)),
scored AS (
  SELECT *, CASE WHEN least(i_s, s_s, f_s, p_s) <= 0 THEN 0e0
                 ELSE exp((ln(i_s) + ln(s_s) + ln(f_s) + ln(p_s)) / 4) END AS gm
  FROM factors)
"""


@query("beacon_factors", FACTORS_SQL + """
SELECT 'all' AS capture_id, src, CAST(port AS INT) AS port, CAST(n AS BIGINT) AS connection_count,
       CAST(g AS BIGINT) AS gap_count, round(med, 4) AS modal_interval_secs,
       round(sd, 4) AS interval_jitter_secs, round(mean_b, 4) AS avg_bytes_orig,
       round(span, 4) AS duration_secs, round(i_s, 6) AS interval_score,
       round(s_s, 6) AS size_score, round(f_s, 6) AS freq_score,
       round(p_s, 6) AS persist_score, round(gm, 6) AS geomean
FROM scored""")
def beacon_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = beacon.beacon_factors(flows(spark, sf_dir), SPEC)
    scale = {c: 4 for c in ("modal_interval_secs", "interval_jitter_secs", "avg_bytes_orig", "duration_secs")}
    scale |= {c: 6 for c in ("interval_score", "size_score", "freq_score", "persist_score", "geomean")}
    return out.withColumns({c: F.round(c, n) for c, n in scale.items()})


@query("beacon_top", FACTORS_SQL + """
, ranked AS (
  SELECT *, row_number() OVER (ORDER BY gm DESC, src, port) AS position FROM scored)
SELECT 'all' AS capture_id, CAST(position AS INT) AS position, src, CAST(port AS INT) AS port,
       round(gm, 6) AS geomean
FROM ranked WHERE position <= 20""")
def beacon_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netquarry.operators.common import top_k

    factors = beacon.beacon_factors(flows(spark, sf_dir), SPEC)
    order = [F.desc("geomean"), F.asc("src"), F.asc("port")]
    top = top_k(factors, ["capture_id"], order, 20, rank="position")
    return top.select("capture_id", "position", "src", "port", F.round("geomean", 6).alias("geomean"))


SPECTRUM_SQL = FACTORS_SQL + """
, steps AS (
  SELECT src, port, gap, row_number() OVER w AS i, sum(gap) OVER w AS clock, count(*) OVER (PARTITION BY src, port) AS n
  FROM gaps WHERE gap IS NOT NULL WINDOW w AS (PARTITION BY src, port ORDER BY ts)),
knots AS (
  SELECT *, lead(clock) OVER w AS next_clock, lead(gap) OVER w AS next_gap,
         min(clock) OVER (PARTITION BY src, port) AS t0, max(clock) OVER (PARTITION BY src, port) AS t1
  FROM steps WHERE n >= 8 WINDOW w AS (PARTITION BY src, port ORDER BY i)),
lengths AS (SELECT DISTINCT src, port, n, t0, t1, (t1 - t0) / (n - 1) AS dt FROM knots),
grid AS (SELECT src, port, n, dt, k, CASE WHEN k = n - 1 THEN t1 ELSE t0 + k * dt END AS t FROM lengths, unnest(range(n)) AS u(k)),
even AS (
  SELECT g.src, g.port, g.n, g.dt, g.k, q.gap + CASE WHEN q.next_clock > q.clock
           THEN (q.next_gap - q.gap) * (g.t - q.clock) / (q.next_clock - q.clock) ELSE 0 END AS x
  FROM grid g ASOF JOIN knots q ON g.src = q.src AND g.port = q.port AND g.t >= q.clock),
waves AS (
  SELECT src, port, f, any_value(n) AS n, any_value(dt) AS dt,
         sqrt(pow(sum(x * cos(2 * pi() * ((f * k) % n) / n)), 2) + pow(sum(x * sin(2 * pi() * ((f * k) % n) / n)), 2)) AS m
  FROM even, unnest(range(1, n // 2 + 1)) AS u(f) GROUP BY src, port, f),
ordered AS (SELECT *, row_number() OVER (PARTITION BY src, port ORDER BY m DESC, f) AS r FROM waves),
peaks AS (
  SELECT src, port, max(CASE WHEN r = 1 THEN m END) AS peak, max(CASE WHEN r = 1 THEN n * dt / f END) AS period,
         median(CASE WHEN r > 1 THEN m END) AS floor FROM ordered GROUP BY src, port),
spectral AS (
  SELECT src, port, peak >= 3 * floor AND floor > 0 AS clear, period,
         greatest(0e0, least(1e0, (peak / (floor + 1e-9) - 3) / 7)) AS score FROM peaks),
full_scores AS (
  SELECT s.*, CASE WHEN clear THEN period ELSE 0e0 END AS sp_period, CASE WHEN clear THEN p.score ELSE 0e0 END AS sp_score,
         least(1e0, gm + 0.1e0 * CASE WHEN clear THEN p.score ELSE 0e0 END) AS composite
  FROM scored s LEFT JOIN spectral p USING (src, port))
"""


@query("beacon_spectral", SPECTRUM_SQL + """
SELECT 'all' AS capture_id, src, CAST(port AS INT) AS port, CAST(g AS BIGINT) AS gap_count,
       round(sp_period, 4) AS spectral_period_secs, round(sp_score, 6) AS spectral_score, round(composite, 6) AS composite_score
FROM full_scores""")
def beacon_spectral(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = beacon.beacon_scores(flows(spark, sf_dir), OPEN_SPEC)
    return out.select(
        "capture_id", "src", "port", "gap_count",
        F.round("spectral_period_secs", 4).alias("spectral_period_secs"),
        *[F.round(c, 6).alias(c) for c in ("spectral_score", "composite_score")],
    )


@query("beacon_candidates", SPECTRUM_SQL + """
, best AS (SELECT *, row_number() OVER (ORDER BY composite DESC, src, port) AS position FROM full_scores)
SELECT 'all' AS capture_id, CAST(position AS INT) AS position, src, CAST(port AS INT) AS port, CAST(n AS BIGINT) AS connection_count,
       round(med, 2) AS modal_interval_secs, round(sd, 2) AS interval_jitter_secs, round(mean_b, 1) AS avg_bytes_orig,
       round(span / 3600, 2) AS duration_hours, round(i_s, 3) AS interval_score, round(s_s, 3) AS size_score,
       round(f_s, 3) AS freq_score, round(p_s, 3) AS persist_score, round(sp_period, 2) AS spectral_period_secs,
       round(composite, 3) AS composite_score
FROM best WHERE position <= 20""")
def beacon_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beacon.beacon_candidates(flows(spark, sf_dir), OPEN_SPEC)
