"""Queries on the connection view: scans, transfers, host classes, networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.functions.net import is_internal
from netquarry.operators import beacon, evidence, inventory, signals as sig
from netquarry.plans import adapters
from netquarry.plans.catalog import query
from netquarry.sources.rules import networks

PORTS, HOSTS = 3, 20


def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.conn_rollup(adapters.conn(spark, sf_dir))


SOURCES_SQL = f"""
WITH {adapters.CONN_SQL},
sources AS (
  SELECT capture_id, orig_h AS src, count(DISTINCT resp_p) AS unique_dst_ports,
         count(DISTINCT resp_h) AS unique_dst_hosts, count(*) AS total_connections,
         min(ts) AS first_ts, max(ts) AS last_ts,
         count(DISTINCT resp_p) >= {PORTS} OR count(DISTINCT resp_h) >= {HOSTS} AS candidate
  FROM conn GROUP BY 1, 2)
"""


@query("scan_sources", SOURCES_SQL + """
SELECT capture_id, src, unique_dst_ports, unique_dst_hosts, total_connections, candidate FROM sources""")
def scan_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.scan_sources(rollup(spark, sf_dir), ports=PORTS, hosts=HOSTS).drop("first_ts", "last_ts")


@query("scan_summary", SOURCES_SQL + """
SELECT s.*, h.scan_syn_only_connection_count FROM (
  SELECT capture_id, CAST(sum(CASE WHEN candidate THEN 1 ELSE 0 END) AS BIGINT) AS scan_candidate_count,
         max(unique_dst_ports) AS scan_max_unique_dst_ports, max(unique_dst_hosts) AS scan_max_unique_dst_hosts
  FROM sources GROUP BY 1) s
JOIN (SELECT capture_id, CAST(sum(CASE WHEN conn_state IN ('S0','REJ','RSTO','RSTOS0') THEN 1 ELSE 0 END) AS BIGINT)
             AS scan_syn_only_connection_count FROM conn GROUP BY 1) h USING (capture_id)""")
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = rollup(spark, sf_dir)
    half_open = pairs.groupBy("capture_id").agg(F.sum("n_half_open").alias("scan_syn_only_connection_count"))
    return sig.scan_summary(sig.scan_sources(pairs, ports=PORTS, hosts=HOSTS)).join(half_open, "capture_id")


@query("scan_candidates", SOURCES_SQL + """
SELECT capture_id, src, unique_dst_ports, unique_dst_hosts, CAST(position AS INT) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY capture_id
         ORDER BY unique_dst_ports DESC, unique_dst_hosts DESC, src) AS position
  FROM sources WHERE candidate) WHERE position <= 10""")
def scan_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = sig.scan_sources(rollup(spark, sf_dir), ports=PORTS, hosts=HOSTS)
    return sig.scan_candidates(sources).select(
        "capture_id", "src", "unique_dst_ports", "unique_dst_hosts", "position"
    )


@query("scan_evidence", SOURCES_SQL + """
, top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id
         ORDER BY unique_dst_ports DESC, unique_dst_hosts DESC, src) AS position
  FROM sources WHERE candidate) WHERE position = 1),
ports AS (
  SELECT capture_id, src, string_agg(CAST(resp_p AS VARCHAR), ',' ORDER BY resp_p) AS ports FROM (
    SELECT capture_id, orig_h AS src, resp_p, row_number() OVER (PARTITION BY capture_id, orig_h ORDER BY resp_p) AS r
    FROM (SELECT DISTINCT capture_id, orig_h, resp_p FROM conn)) WHERE r <= 50 GROUP BY 1, 2),
targets AS (
  SELECT capture_id, src, string_agg(resp_h, ',' ORDER BY resp_h) AS hosts FROM (
    SELECT capture_id, orig_h AS src, resp_h, row_number() OVER (PARTITION BY capture_id, orig_h ORDER BY resp_h) AS r
    FROM (SELECT DISTINCT capture_id, orig_h, resp_h FROM conn)) WHERE r <= 20 GROUP BY 1, 2)
SELECT t.capture_id, t.src AS scanner_ip, t.unique_dst_ports AS port_count, p.ports,
       t.unique_dst_hosts AS host_count, g.hosts, t.total_connections,
       round(t.last_ts - t.first_ts, 3) AS duration_secs
FROM top t JOIN ports p USING (capture_id, src) JOIN targets g USING (capture_id, src)""")
def scan_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    conn = adapters.conn(spark, sf_dir)
    sources = sig.scan_sources(sig.conn_rollup(conn), ports=PORTS, hosts=HOSTS)
    return evidence.scan_evidence(conn, sources).select(
        "capture_id", "scanner_ip",
        F.col("unique_dst_ports_count").alias("port_count"),
        F.array_join(F.col("unique_dst_ports").cast("array<string>"), ",").alias("ports"),
        F.col("unique_dst_hosts_count").alias("host_count"),
        F.array_join("unique_dst_hosts_sample", ",").alias("hosts"),
        "total_connections",
        F.round("duration_secs", 3).alias("duration_secs"),
    )


@query("inbound_scanners", f"""
WITH {adapters.CONN_SQL}
SELECT capture_id, resp_h AS src, count(DISTINCT resp_p) AS unique_ports
FROM conn WHERE conn_state IN ('S0', 'REJ', 'RSTO') GROUP BY 1, 2 HAVING count(DISTINCT resp_p) >= 1""")
def inbound_scanners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source and target swapped, so that the external side connects."""
    conn = adapters.conn(spark, sf_dir)
    conn = conn.withColumns({"orig_h": F.col("resp_h"), "resp_h": F.col("orig_h")})
    return sig.inbound_scanners(sig.conn_rollup(conn), min_ports=1)


TRANSFERS_SQL = f"""
WITH {adapters.CONN_SQL},
big AS (SELECT * FROM conn WHERE orig_bytes > 20000)
"""


@query("outbound_transfers", TRANSFERS_SQL + """
SELECT capture_id, uid, orig_h, resp_h, CAST(resp_p AS INT) AS resp_p, orig_bytes FROM big""")
def outbound_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sig.outbound_transfers(adapters.conn(spark, sf_dir), floor=20_000)
    return out.select("capture_id", "uid", "orig_h", "resp_h", "resp_p", "orig_bytes")


@query("exfil_signals", TRANSFERS_SQL + """
SELECT capture_id, max(orig_bytes) AS max_outbound_bytes FROM conn
WHERE capture_id IN (SELECT capture_id FROM big) GROUP BY 1""")
def exfil_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.exfil_signals(adapters.conn(spark, sf_dir), floor=20_000)


@query("winrm_count", f"""
WITH {adapters.CONN_SQL}
SELECT capture_id, CAST(sum(CASE WHEN resp_p IN (5985, 5986) THEN 1 ELSE 0 END) AS BIGINT) AS winrm_connection_count
FROM conn GROUP BY 1""")
def winrm_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.scan_signals(adapters.conn(spark, sf_dir)).select("capture_id", "winrm_connection_count")


@query("host_classes", f"""
WITH {adapters.CONN_SQL},
ips AS (SELECT orig_h AS ip FROM conn UNION SELECT resp_h FROM conn)
SELECT ip, ip LIKE '10.%' AS is_internal FROM ips""")
def host_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    conn = adapters.conn(spark, sf_dir)
    ips = conn.select(F.explode(F.array("orig_h", "resp_h")).alias("ip")).distinct()
    return ips.withColumn("is_internal", is_internal(F.col("ip")))


NETS = ["203.0.113.0/26", "203.0.113.96/28", "10.0.0.128/25"]


@query("cidr_members", f"""
WITH {adapters.CONN_SQL},
n AS (
  SELECT capture_id, split_part(resp_h, '.', 4)::INT AS d, split_part(orig_h, '.', 3)::INT AS oc,
         split_part(orig_h, '.', 4)::INT AS o4 FROM conn)
SELECT capture_id, CAST(sum(CASE WHEN d < 64 OR d BETWEEN 96 AND 111 THEN 1 ELSE 0 END) AS BIGINT) AS resp_members,
       CAST(sum(CASE WHEN oc = 0 AND o4 >= 128 THEN 1 ELSE 0 END) AS BIGINT) AS orig_members
FROM n GROUP BY 1""")
def cidr_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections per capture whose ends lie in a table of networks.

    Rows are counted per address before they meet the networks.
    """
    conn = adapters.conn(spark, sf_dir)
    nets = networks(spark, NETS)

    def members(column: str, name: str) -> DataFrame:
        counts = conn.groupBy("capture_id", column).agg(F.count("*").alias("n"))
        return inventory.cidr_semi_join(counts, column, nets).groupBy("capture_id").agg(F.sum("n").alias(name))

    captures = conn.select("capture_id").distinct()
    return (
        captures.join(members("resp_h", "resp_members"), "capture_id", "left")
        .join(members("orig_h", "orig_members"), "capture_id", "left")
        .na.fill(0)
    )


@query("outbound_flows", f"""
WITH {adapters.CONN_SQL}
SELECT capture_id, orig_h AS src, count(*) AS flows, CAST(sum(orig_bytes) AS DOUBLE) AS bytes
FROM conn WHERE split_part(orig_h, '.', 4)::INT % 2 = 0 GROUP BY 1, 2""")
def outbound_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows from an explicit table of internal hosts to all others, by semi and anti join."""
    conn = adapters.conn(spark, sf_dir)
    inside = F.split_part("ip", F.lit("."), F.lit(4)).cast("int") % 2 == 0
    ips = conn.select("capture_id", F.col("orig_h").alias("ip")).distinct()
    hosts = ips.withColumn("is_internal", inside)
    flows = beacon.outbound_flows(conn, hosts=hosts)
    return flows.groupBy("capture_id", "src").agg(F.count("*").alias("flows"), F.sum("orig_bytes").alias("bytes"))


@query("http_odd_ports", f"""
WITH {adapters.CONN_SQL}
SELECT capture_id, CAST(sum(CASE WHEN resp_p NOT IN (80, 8080) THEN 1 ELSE 0 END) AS BIGINT) AS http_request_odd_port_count
FROM conn GROUP BY 1""")
def http_odd_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests off the usual ports, every connection taken as one request."""
    return sig.http_odd_port_requests(adapters.conn(spark, sf_dir))


SPREAD_SQL = f"""
WITH {adapters.CONN_SQL}, {adapters.PACKETS_SQL},
spread AS (SELECT 'cap-' || (uid % 5) AS capture_id, * EXCLUDE (capture_id) FROM conn),
ips AS (SELECT capture_id, ip_src AS ip FROM packets UNION SELECT capture_id, ip_dst FROM packets),
thresholds AS (
  SELECT capture_id, 20 AS ports, greatest(10, CAST(floor(count(*) * 0.2e0) AS BIGINT)) AS hosts FROM ips GROUP BY 1),
sources AS (
  SELECT capture_id, orig_h AS src, count(DISTINCT resp_p) AS p, count(DISTINCT resp_h) AS h FROM spread GROUP BY 1, 2)
"""


@query("scan_signals", SPREAD_SQL + """
SELECT s.capture_id, CAST(sum(CASE WHEN p >= ports OR h >= hosts THEN 1 ELSE 0 END) AS BIGINT) AS scan_candidate_count,
       max(p) AS scan_max_unique_dst_ports, max(h) AS scan_max_unique_dst_hosts, any_value(half) AS scan_syn_only_connection_count,
       any_value(winrm) AS winrm_connection_count, CAST(0 AS BIGINT) AS inbound_scan_unique_src_count
FROM sources s JOIN thresholds t ON t.capture_id = s.capture_id
JOIN (SELECT capture_id, CAST(sum(CASE WHEN conn_state = 'S0' THEN 1 ELSE 0 END) AS BIGINT) AS half,
             CAST(sum(CASE WHEN resp_p = 5985 THEN 1 ELSE 0 END) AS BIGINT) AS winrm FROM spread GROUP BY 1) c
  ON c.capture_id = s.capture_id
GROUP BY 1""")
def scan_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scan signals with the calibrated thresholds of the packet captures."""
    thresholds = inventory.calibrate(inventory.captures(adapters.packets(spark, sf_dir)))
    conn = adapters.conn(spark, sf_dir).withColumn("capture_id", F.expr("concat('cap-', uid % 5)"))
    return sig.scan_signals(conn, thresholds=thresholds)
