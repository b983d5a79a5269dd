"""Queries on indicators, intelligence, files, victims and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.functions.lists import SAFE_DOMAINS
from netquarry.operators import artifacts, beacon, evidence, filters, inventory, ioc, report, signals as sig
from netquarry.plans import adapters, queries_beacon
from netquarry.plans.catalog import ORACLES, query
from netquarry.plans.queries_packets import CONVERSATIONS_SQL
from netquarry.plans.queries_rules import all_signals, findings, signals_sql, spread_alerts
from netquarry.session import local_table
from netquarry.sources.files import load_yaml
from netquarry.sources.rules import BUILTIN, Allowlist, load_allowlist, networks

# ---------------------------------------------------------------------------- files


@query("file_duplicates", f"""
WITH {adapters.FILES_SQL},
groups AS (
  SELECT capture_id, sha256, count(*) AS file_count, min(filename) AS filename FROM files GROUP BY 1, 2)
SELECT capture_id, sha256, file_count, filename, CAST(position AS INT) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY file_count DESC, sha256) AS position FROM groups)
WHERE position <= 15""")
def file_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = artifacts.duplicate_files(adapters.files(spark, sf_dir))
    return out.select("capture_id", "sha256", "file_count", "filename", "position")


@query("file_totals", f"""
WITH {adapters.FILES_SQL}
SELECT capture_id, count(*) AS files, count(DISTINCT sha256) AS unique_hashes FROM files GROUP BY 1""")
def file_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts.file_totals(adapters.files(spark, sf_dir))


@query("mime_types", f"""
WITH {adapters.FILES_SQL}
SELECT capture_id, lower(filename) AS name_key, arg_max(mime_type, ts) AS mime_type FROM files GROUP BY 1, 2""")
def mime_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts.mime_types(adapters.files(spark, sf_dir))


@query("ioc_hashes", f"""
WITH {adapters.FILES_SQL}
SELECT capture_id, sha256, mime_type, tx_hosts AS source, extracted AS filename FROM files""")
def ioc_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ioc.ioc_hashes(adapters.files(spark, sf_dir))


# ------------------------------------------------------------------------ indicators


def talkers(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Begins are subtracted from the few rows kept: a join by capture below the ranking may deal all conversations by capture.
    packets = adapters.packets(spark, sf_dir)
    return inventory.from_start(inventory.top_talkers(inventory.timed_conversations(packets)), packets)


TALKERS_SQL = CONVERSATIONS_SQL + """
, talkers AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY bytes_total DESC, src, dst) AS position
  FROM convs) WHERE position <= 20)
"""


SAFE = ", ".join(f"'{d}'" for d in SAFE_DOMAINS)


@query("ioc_domains", f"""
WITH {adapters.DNS_SQL}, {adapters.ALERTS_SQL},
parents AS (
  SELECT capture_id, split_part(query, '.', -2) || '.' || split_part(query, '.', -1) AS domain
  FROM dns GROUP BY 1, 2 HAVING count(DISTINCT query) > 10),
named AS (
  SELECT 'cap-' || (CAST(timestamp AS BIGINT) % 5) AS capture_id,
         unnest(regexp_extract_all(signature, '(?i)\\(([a-z0-9][a-z0-9\\-._]{{2,}}\\s*\\.[a-z]{{2,10}})\\)', 1)) AS d FROM alerts)
SELECT capture_id, domain FROM parents WHERE domain NOT IN ({SAFE})
UNION SELECT capture_id, lower(replace(d, ' ', '')) FROM named""")
def ioc_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ioc.ioc_domains(sig.top_parents(adapters.dns(spark, sf_dir)), spread_alerts(spark, sf_dir))


ALLOWED = ["203.0.113.0/28"]
ORDER_SQL = f"""
WITH {adapters.PACKETS_SQL} {TALKERS_SQL}
, tiers AS (
  SELECT capture_id, src AS ip, 2 AS tier, position * 2 AS o, 'top_talker' AS source FROM talkers
  UNION ALL SELECT capture_id, dst, 2, position * 2 + 1, 'top_talker' FROM talkers
  UNION ALL SELECT DISTINCT capture_id, ip_dst, 3, 0, 'external_ip' FROM packets),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY capture_id, ip ORDER BY tier, o) AS r FROM tiers
  WHERE ip NOT LIKE '10.%' AND NOT CAST(split_part(ip, '.', 4) AS INT) < 16),
targets AS (
  SELECT capture_id, ip, source, CAST(position AS INT) AS position FROM (
    SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY tier, o, ip) AS position FROM ranked WHERE r = 1)
  WHERE position <= 20)
"""


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = inventory.hosts(adapters.packets(spark, sf_dir))
    allow = Allowlist(networks(spark, ALLOWED), local_table(spark, [], "domain string"), [], 1)
    allowed = inventory.mark_allowed(hosts.select("ip").distinct(), allow).where("allowed")
    return ioc.enrichment_targets(hosts, talkers(spark, sf_dir), allowed=allowed)


@query("enrichment_order", ORDER_SQL + "SELECT * FROM targets")
def enrichment_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets(spark, sf_dir)


def reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One address per supplier, its engine count from the key."""
    return adapters.table(spark, sf_dir, "supplier").select(
        F.expr("concat('203.0.113.', s_suppkey)").alias("ip"),
        F.col("s_name").alias("owner"),
        F.lit("ZZ").alias("country"),
        F.expr("s_suppkey % 6").alias("malicious"),
        F.expr("s_suppkey % 2").alias("suspicious"),
        F.lit(0).cast("bigint").alias("reputation"),
    )


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several hits per address, from part."""
    return adapters.table(spark, sf_dir, "part").select(
        F.expr("concat('203.0.113.', p_partkey % 40 * 3)").alias("term"),
        F.expr("concat('203.0.113.', p_partkey % 40 * 3)").alias("ioc"),
        F.lit("botnet_cc").alias("threat_type"),
        F.col("p_name").alias("malware"),
        F.expr("p_partkey % 97").alias("confidence"),
        F.expr("lpad(p_partkey, 9, '0')").alias("first_seen"),
        F.array("p_brand").alias("tags"),
        F.expr("p_partkey % 50 = 0").alias("has_samples"),
    )


FEED_SQL = """
hits AS (
  SELECT '203.0.113.' || (p_partkey % 40 * 3) AS term, p_name AS malware, p_partkey % 97 AS confidence,
         lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS first_seen, p_partkey % 50 = 0 AS has_samples FROM part),
best AS (
  SELECT term, arg_max(malware, confidence * 1e9 + CAST(first_seen AS BIGINT)) AS malware, max(confidence) AS confidence,
         count(*) AS total_hits, bool_or(has_samples) AS has_samples FROM hits GROUP BY 1)
"""


@query("best_feed_hit", f"WITH {FEED_SQL} SELECT * FROM best")
def best_feed_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ioc.best_feed_hit(feed(spark, sf_dir))
    return out.select("term", "malware", "confidence", "total_hits", "has_samples")


@query("confirmed", ORDER_SQL + f"""
, {FEED_SQL}
SELECT t.capture_id, t.ip, t.position, t.source, coalesce(s.s_suppkey % 6, 0) AS vt_malicious, coalesce(s.s_name, '') AS vt_owner,
       b.term IS NOT NULL AS threatfox_found, coalesce(b.malware, '') AS threatfox_malware,
       coalesce(b.confidence, 0) AS threatfox_confidence,
       coalesce(s.s_suppkey % 6, 0) >= 3 OR coalesce(b.confidence, 0) >= 75 AS is_confirmed_malicious
FROM targets t LEFT JOIN supplier s ON '203.0.113.' || s.s_suppkey = t.ip
LEFT JOIN best b ON b.term = t.ip""")
def confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ioc.enrich(targets(spark, sf_dir), reputation(spark, sf_dir), feed(spark, sf_dir))
    return out.select(
        "capture_id", "ip", "position", "source", "vt_malicious", "vt_owner", "threatfox_found", "threatfox_malware",
        "threatfox_confidence", "is_confirmed_malicious",
    )


@query("ioc_ips", f"""
WITH {adapters.PACKETS_SQL}, {adapters.HTTP_SQL}, {adapters.ALERTS_SQL}, {adapters.CONN_SQL} {TALKERS_SQL}
, found AS (
  SELECT capture_id, dst AS ip, 'top_talker' AS reason FROM talkers WHERE position <= 15 AND dst NOT LIKE '10.%'
  UNION SELECT capture_id, resp_h, 'post_destination' FROM http WHERE method = 'POST'
  UNION SELECT 'cap-' || (CAST(timestamp AS BIGINT) % 5), dst_ip, 'alert_destination' FROM alerts
  UNION SELECT 'cap-' || (uid % 5), resp_h, 'large_transfer' FROM conn WHERE orig_bytes > 20000
  UNION SELECT 'cap-' || (uid % 5), resp_h, 'scanner' FROM conn GROUP BY 1, 2
        HAVING count(DISTINCT resp_p) >= 15 OR count(DISTINCT orig_h) >= 10
  UNION SELECT capture_id, ip, 'certificate_anomaly' FROM ({ORACLES["tls_anomaly_ips"]})
  UNION SELECT capture_id, ip, 'confirmed_malicious' FROM ({ORACLES["confirmed"]}) WHERE is_confirmed_malicious)
SELECT capture_id, ip, string_agg(reason, ',' ORDER BY reason) AS reasons FROM found GROUP BY 1, 2""")
def ioc_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven sources; scanners from connections read backwards, so that the external side connects."""
    conn = adapters.spread_conn(spark, sf_dir)
    backwards = conn.withColumns({"orig_h": F.col("resp_h"), "resp_h": F.col("orig_h")})
    enriched = ioc.enrich(targets(spark, sf_dir), reputation(spark, sf_dir), feed(spark, sf_dir))
    out = ioc.ioc_ips(
        talkers=talkers(spark, sf_dir),
        scans=sig.scan_sources(backwards).where("candidate"),
        transfers=sig.outbound_transfers(conn, floor=20_000),
        posts=sig.post_destinations(adapters.http(spark, sf_dir)),
        tls_ips=sig.tls_anomaly_ips(adapters.ssl(spark, sf_dir), adapters.x509(spark, sf_dir)),
        confirmed=enriched.where("is_confirmed_malicious"),
        alerts=spread_alerts(spark, sf_dir),
    )
    return out.withColumn("reasons", F.array_join("reasons", ","))


@query("allowed_ips", f"""
WITH {adapters.PACKETS_SQL}
SELECT DISTINCT ip_dst AS ip, ip_dst LIKE '203.0.113.%' AND CAST(split_part(ip_dst, '.', 4) AS INT) < 16 AS allowed FROM packets""")
def allowed_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    allow = Allowlist(networks(spark, ALLOWED), local_table(spark, [], "domain string"), [], 1)
    return inventory.mark_allowed(adapters.packets(spark, sf_dir).select(F.col("ip_dst").alias("ip")).distinct(), allow)


@query("allowed_domains", f"""
WITH {adapters.DNS_SQL}
SELECT DISTINCT query AS domain, query LIKE '%.example.org' OR query = 'example.org' AS allowed FROM dns""")
def allowed_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    builtin = load_allowlist(spark)
    domains = builtin.domains.unionByName(local_table(spark, [{"domain": "example.org"}], "domain string"))
    allow = Allowlist(builtin.nets, domains, builtin.protocols, builtin.rule_count + 1)
    names = adapters.dns(spark, sf_dir).select(F.col("query").alias("domain")).distinct()
    return inventory.mark_allowed(names, allow, kind="domain")


# ---------------------------------------------------------------------------- beacons


@query("external_beacons", """
WITH b AS (
  SELECT 'cap-' || (s_suppkey % 4) AS capture_id, round(abs(s_acctbal) / 1e4, 4) AS score FROM supplier)
SELECT capture_id, true AS rita_available, round(max(score), 4) AS rita_top_beacon_score,
       CAST(sum(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS rita_beacon_pairs FROM b GROUP BY 1""")
def external_beacons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from supplier balances, as an external tool would give them."""
    scores = adapters.table(spark, sf_dir, "supplier").select(
        F.expr("concat('cap-', s_suppkey % 4)").alias("capture_id"),
        F.expr("round(abs(s_acctbal) / 1e4, 4)").alias("score"),
    )
    return beacon.external_beacon_signals(scores)


@query("top_external_beacons", """
SELECT capture_id, src_ip, score, CAST(position AS INT) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY score DESC, src_ip) AS position FROM (
    SELECT 'cap-' || (s_suppkey % 4) AS capture_id, round(abs(s_acctbal) / 1e4, 4) AS score, s_name AS src_ip FROM supplier))
WHERE position <= 20""")
def top_external_beacons(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = adapters.table(spark, sf_dir, "supplier").select(
        F.expr("concat('cap-', s_suppkey % 4)").alias("capture_id"),
        F.expr("round(abs(s_acctbal) / 1e4, 4)").alias("score"),
        F.col("s_name").alias("src_ip"),
        F.lit("203.0.113.1").alias("dst_ip"),
    )
    return beacon.top_external_beacons(scores).drop("dst_ip")


@query("external_addresses", f"""
WITH {adapters.PACKETS_SQL} {TALKERS_SQL}, {adapters.CONN_SQL}
SELECT DISTINCT capture_id, dst AS ip FROM talkers WHERE position <= 12 AND dst NOT LIKE '10.%'
UNION
SELECT 'cap-' || (uid % 5), resp_h FROM conn WHERE orig_bytes > 20000""")
def external_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    conn = adapters.conn(spark, sf_dir).withColumn("capture_id", F.expr("concat('cap-', uid % 5)"))
    return filters.external_addresses(talkers(spark, sf_dir), sig.outbound_transfers(conn, floor=20_000))


# ----------------------------------------------------------------------------- victims


def leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases from customer; some without assigned address, those of two captures without any."""
    return adapters.table(spark, sf_dir, "customer").select(
        F.expr("concat('cap-', c_custkey % 5)").alias("capture_id"),
        F.expr("CAST(c_custkey AS DOUBLE)").alias("ts"),
        F.expr("CASE WHEN c_custkey % 5 < 3 THEN concat('10.0.0.', c_custkey % 200) END").alias("client_addr"),
        F.expr("CASE WHEN c_custkey % 5 < 3 AND c_custkey % 2 = 0 THEN concat('10.0.0.', c_custkey % 100) END").alias("assigned_addr"),
        F.expr("concat('mac-', c_custkey)").alias("mac"),
        F.expr("CASE WHEN c_custkey % 5 = 0 THEN c_name END").alias("host_name"),
        F.expr("CASE WHEN c_custkey % 5 = 1 THEN 'lease.example' END").alias("domain"),
    )


@query("victim_identity", f"""
WITH {adapters.KERBEROS_SQL}, {adapters.SMB_SQL}, {adapters.PACKETS_SQL},
dhcp AS (
  SELECT 'cap-' || (c_custkey % 5) AS capture_id, c_custkey AS ts,
         CASE WHEN c_custkey % 5 < 3 THEN
           coalesce(CASE WHEN c_custkey % 2 = 0 THEN '10.0.0.' || (c_custkey % 100) END, '10.0.0.' || (c_custkey % 200)) END AS ip,
         'mac-' || c_custkey AS mac, CASE WHEN c_custkey % 5 = 0 THEN c_name END AS host_name,
         CASE WHEN c_custkey % 5 = 1 THEN 'lease.example' END AS domain
  FROM customer),
lease AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY ts) AS r FROM dhcp WHERE ip IS NOT NULL) WHERE r = 1),
login AS (
  SELECT * FROM (SELECT *, split_part(client, '/', 1) AS u, row_number() OVER (PARTITION BY capture_id
    ORDER BY split_part(client, '/', 1) LIKE '%$', ts, client) AS r FROM kerberos) WHERE r = 1),
server AS (
  SELECT capture_id, arg_min('corp.example.com', ts) AS d FROM (
    SELECT *, CASE WHEN capture_id <> 'cap-2' THEN path END AS named FROM smb) WHERE named LIKE '%.corp.example.com%' GROUP BY 1),
base AS (
  SELECT g.capture_id, coalesce(l.ip, g.orig_h) AS ip, l.host_name, l.mac AS lease_mac, g.u AS windows_user,
         coalesce(s.d, l.domain, 'corp.example') AS domain
  FROM login g LEFT JOIN lease l USING (capture_id) LEFT JOIN server s USING (capture_id)),
locals AS (
  SELECT capture_id, ip_src AS ip, arg_min(dns_qry_name, frame_no) AS q FROM packets GROUP BY 1, 2),
macs AS (
  SELECT capture_id, ip_src AS ip, arg_min(eth_src, f) AS m FROM (
    SELECT capture_id, ip_src, eth_src, min(frame_no) AS f FROM packets GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT b.capture_id, coalesce(b.host_name, split_part(q, '.', 1)) AS hostname, b.ip, coalesce(lease_mac, m) AS mac,
       windows_user, domain
FROM base b LEFT JOIN locals USING (capture_id, ip) LEFT JOIN macs USING (capture_id, ip)""")
def victim_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three captures with leases, two without; one without file-server names."""
    packets = adapters.packets(spark, sf_dir)
    shares = adapters.smb(spark, sf_dir).withColumn("path", F.expr("CASE WHEN capture_id <> 'cap-2' THEN path END"))
    # Every name of the view ends so and holds it once, so no pattern has to run over each packet.
    lookups = packets.select(
        "capture_id", F.col("frame_no").alias("ts"), F.col("ip_src").alias("orig_h"),
        F.replace("dns_qry_name", F.lit(".example.com"), F.lit(".local")).alias("query"),
    )
    return report.victim_identity(
        leases(spark, sf_dir), adapters.kerberos(spark, sf_dir), shares, lookups, inventory.mac_ip(packets)
    )


@query("primary_victim", f"""
WITH {adapters.PACKETS_SQL} {TALKERS_SQL}
SELECT capture_id, arg_min(src, position) AS victim FROM talkers WHERE src LIKE '10.%' GROUP BY 1""")
def primary_victim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.primary_victim(talkers(spark, sf_dir), inventory.hosts(adapters.packets(spark, sf_dir)))


@query("lan_segment", f"""
WITH {adapters.PACKETS_SQL}
SELECT capture_id, ip FROM (SELECT capture_id, ip_src AS ip FROM packets UNION SELECT capture_id, ip_dst FROM packets)
WHERE ip LIKE '10.%' AND ip NOT LIKE '%.255'""")
def lan_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.lan_segment(inventory.hosts(adapters.packets(spark, sf_dir)))


@query("visible_protocols", """
SELECT DISTINCT 'cap-' || (l_orderkey % 5) AS capture_id, 'dns,http,kerberos,smb2,tls' AS protocols FROM lineitem""")
def visible_protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = inventory.protocols_present(inventory.protocol_histogram(adapters.packets(spark, sf_dir)))
    return report.visible_protocols(present).withColumn("protocols", F.array_join("protocols", ","))


# ----------------------------------------------------------------------------- report


def summary_sql() -> str:
    """The summary from the oracles of its parts."""
    names = ", ".join(
        f"('{d['ttp_id']}', '{d['name']}')"
        for path in sorted((BUILTIN / "playbooks").rglob("*.yaml"))
        for d in load_yaml(path.read_text())
    )
    return f"""
WITH {adapters.ALERTS_SQL},
f AS ({ORACLES["rule_boosts"]}), v AS ({ORACLES["victim_identity"]}), e AS ({ORACLES["confirmed"]}),
names(ttp_id, name) AS (VALUES {names}),
ranked AS (
  SELECT f.capture_id, n.name, row_number() OVER (PARTITION BY f.capture_id ORDER BY
         CASE confidence WHEN 'CONFIRMED' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END,
         score DESC, f.ttp_id) AS r FROM f JOIN names n ON n.ttp_id = f.ttp_id),
top AS (
  SELECT capture_id, string_agg(name, '; ' ORDER BY r) AS top_techniques FROM ranked WHERE r BETWEEN 2 AND 4 GROUP BY 1),
counts AS (
  SELECT capture_id, count(*) AS findings, CAST(sum(CASE WHEN confidence IN ('CONFIRMED', 'HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high,
         CAST(sum(CASE WHEN confidence = 'MEDIUM' THEN 1 ELSE 0 END) AS BIGINT) AS medium,
         CAST(sum(CASE WHEN confidence = 'LOW' THEN 1 ELSE 0 END) AS BIGINT) AS low,
         count(DISTINCT category) AS tactic_areas FROM f GROUP BY 1),
family AS (
  SELECT 'cap-' || (CAST(timestamp AS BIGINT) % 5) AS capture_id,
         arg_min(regexp_extract(signature, '(Win\\d+/[\\w\\s]+?\\w)', 1), timestamp) AS malware_family
  FROM alerts WHERE regexp_matches(signature, 'Win\\d+/[\\w\\s]+?\\w') GROUP BY 1),
bad AS (
  SELECT capture_id, string_agg(ip, ',' ORDER BY ip) AS confirmed_ips FROM e WHERE is_confirmed_malicious GROUP BY 1)
SELECT c.*, CASE WHEN high > 0 THEN 'high' WHEN medium > 0 THEN 'medium' ELSE 'low' END AS severity, malware_family,
       coalesce(confirmed_ips, '') AS confirmed_ips, coalesce(top_techniques, '') AS top_techniques,
       CASE WHEN v.hostname IS NULL THEN coalesce(v.ip, 'unknown host')
            ELSE v.hostname || ' (' || coalesce(v.ip, 'unknown host') || ')' END
       || CASE WHEN v.windows_user IS NULL THEN '' ELSE ', user ' || v.windows_user END AS victim
FROM counts c LEFT JOIN top USING (capture_id) LEFT JOIN family USING (capture_id) LEFT JOIN bad USING (capture_id)
LEFT JOIN v USING (capture_id)"""


@query("summary", summary_sql())
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    victims = victim_identity(spark, sf_dir)
    enriched = ioc.enrich(targets(spark, sf_dir), reputation(spark, sf_dir), feed(spark, sf_dir))
    out = report.summary(findings(spark, sf_dir), victims, enriched, spread_alerts(spark, sf_dir))
    return out.withColumns({
        "confirmed_ips": F.array_join("confirmed_ips", ","),
        "top_techniques": F.array_join("top_techniques", "; "),
    })


def beacons_by_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best beacons dealt over the five captures, each with a target made from its port."""
    best = beacon.beacon_candidates(queries_beacon.flows(spark, sf_dir), queries_beacon.OPEN_SPEC)
    return best.select(
        F.expr("concat('cap-', position % 5)").alias("capture_id"), F.expr("CAST((position - 1) DIV 5 + 1 AS INT)").alias("position"),
        "src", F.expr("concat('203.0.113.', port % 250)").alias("dst"), "port")


def filters_sql() -> str:
    """Every section by itself, from the templates as VALUES."""
    def listed(entries) -> str:
        text = lambda x: "'" + x.replace("'", "''") + "'"
        return "VALUES " + ", ".join(f"({text(k)}, {i}, {text(label)}, {text(t)})" for i, (k, label, t) in enumerate(entries, 1))

    def flat(templates: dict) -> list[tuple[str, str, str]]:
        return [(k, label, t) for k, entries in templates.items() for label, t in entries]

    fill = "text"
    for name in filters.PLACEHOLDERS:
        fill = f"CASE WHEN contains({fill}, '{{{name}}}') THEN replace({fill}, '{{{name}}}', {name}) ELSE {fill} END"
    counts = ", ".join(f"('{k}', {k})" for k in filters.PROTOCOL_FILTERS if k != "directory_packet_count")
    combined = [("|".join(ttps), label, t) for ttps, label, t in filters.COMBINED_FILTERS]
    moment = lambda c: f"strftime(to_timestamp({c}) AT TIME ZONE 'UTC', '%b %d, %Y %H:%M:%S')"
    named = "'dns.qry.name contains \"' || domain || '\"'"
    return f"""
WITH {signals_sql()}, {adapters.CONN_SQL},
spread AS (SELECT 'cap-' || (uid % 5) AS capture_id, * EXCLUDE (capture_id) FROM conn),
fired AS (SELECT DISTINCT capture_id, ttp_id FROM ({ORACLES["rule_boosts"]}) WHERE score >= {filters.REPORT_THRESHOLD}),
ids AS (SELECT capture_id, list(ttp_id) AS ids FROM fired GROUP BY 1),
sources AS (
  SELECT capture_id, orig_h AS src, count(DISTINCT resp_p) AS p, count(DISTINCT resp_h) AS h FROM spread GROUP BY 1, 2),
scanners AS (
  SELECT capture_id, src AS scanner FROM sources WHERE p >= 3 OR h >= 20
  QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY p DESC, h DESC, src) = 1),
aims AS (
  SELECT capture_id, string_agg('ip.addr == ' || resp_h, ' || ' ORDER BY resp_h) AS targets FROM (
    SELECT DISTINCT s.capture_id, s.resp_h, dense_rank() OVER (PARTITION BY s.capture_id ORDER BY s.resp_h) AS r
    FROM spread s JOIN scanners c ON c.capture_id = s.capture_id AND c.scanner = s.orig_h) WHERE r <= 5 GROUP BY 1),
domains AS (
  SELECT capture_id, parent AS domain, row_number() OVER (PARTITION BY capture_id ORDER BY fqdn_count DESC, parent) AS pos
  FROM ({ORACLES["dns_parents"]}) WHERE fqdn_count > 10 QUALIFY pos <= 20),
domains3 AS (SELECT capture_id, string_agg({named}, ' || ' ORDER BY pos) AS domains3 FROM domains WHERE pos <= 3 GROUP BY 1),
ips AS (
  SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY ip) AS pos FROM ({ORACLES["external_addresses"]}) QUALIFY pos <= 15),
beacons AS (
  SELECT 'cap-' || (position % 5) AS capture_id, (position - 1) // 5 + 1 AS pos, src, '203.0.113.' || (port % 250) AS dst, port
  FROM ({ORACLES["beacon_candidates"]})),
context AS (
  SELECT w.capture_id, coalesce(v.victim, 'VICTIM_IP') AS victim, coalesce(c.scanner, v.victim, 'VICTIM_IP') AS scanner, dc,
         coalesce(' && ip.addr == ' || dc, '') AS dc_addr, coalesce(' && ip.dst == ' || dc, '') AS dc_dst, targets, domains3,
         coalesce(ids, []) AS ids
  FROM wide w LEFT JOIN ({ORACLES["primary_victim"]}) v USING (capture_id) LEFT JOIN scanners c USING (capture_id)
  LEFT JOIN ({ORACLES["controller"]}) d USING (capture_id) LEFT JOIN aims USING (capture_id)
  LEFT JOIN domains3 USING (capture_id) LEFT JOIN ids USING (capture_id)),
present AS (
  SELECT w.capture_id, t.source FROM wide w, LATERAL (VALUES {counts}, ('directory_packet_count', ldap_packet_count + cldap_packet_count)) t(source, n)
  WHERE n > 0),
quick(k, pos, label, text) AS ({listed([("", *t) for t in filters.QUICK_FILTERS])}),
victims(k, pos, label, text) AS ({listed([("", *t) for t in filters.VICTIM_FILTERS])}),
by_finding(k, pos, label, text) AS ({listed(flat(filters.FINDING_FILTERS))}),
by_protocol(k, pos, label, text) AS ({listed(flat(filters.PROTOCOL_FILTERS))}),
by_any(k, pos, label, text) AS ({listed(combined)}),
filled AS (
  SELECT capture_id, section, ttp_id, pos, label, {fill} AS filter FROM (
    SELECT c.*, {filters.QUICK} AS section, '' AS ttp_id, pos, label, text FROM context c, quick
    UNION ALL SELECT c.*, {filters.VICTIM}, '', pos, label, text FROM context c, victims
    UNION ALL SELECT c.*, {filters.FINDING}, k, pos, label, text FROM context c JOIN by_finding ON list_contains(ids, k)
    UNION ALL SELECT c.*, {filters.PROTOCOL}, '', pos, label, text FROM context c JOIN present p USING (capture_id) JOIN by_protocol ON k = source
    UNION ALL SELECT c.*, {filters.COMBINED}, '', pos, label, text FROM context c JOIN by_any ON k = '' OR list_has_any(ids, string_split(k, '|')))),
times AS (
  SELECT capture_id, unnest([
    {{'pos': 1, 'label': 'whole capture', 'text': 'frame.time >= "' || {moment("start_ts")} || '" && frame.time <= "' || {moment("end_ts")} || '"'}},
    {{'pos': 2, 'label': 'first 10 minutes', 'text': 'frame.time >= "' || {moment("start_ts")} || '" && frame.time_relative <= 600'}},
    {{'pos': 3, 'label': 'last 10 minutes', 'text': 'frame.time_relative >= ' || CAST(greatest(0, floor(duration_secs) - 600) AS BIGINT)}}]) AS t
  FROM ({ORACLES["captures"]}))
SELECT capture_id, section, ttp_id, CAST(pos AS INT) AS "at", label, filter FROM (
  SELECT * FROM filled
  UNION ALL SELECT d.capture_id, {filters.FINDING}, ttp_id, pos + 1000, 'suspicious domain ' || domain, {named}
            FROM domains d JOIN fired f USING (capture_id) WHERE pos <= 3 AND ttp_id IN {filters.DOMAIN_TECHNIQUES}
  UNION ALL SELECT capture_id, {filters.ADDRESS}, '', pos * 2 - 1, 'traffic of ' || ip, 'ip.addr == ' || ip FROM ips JOIN context USING (capture_id)
  UNION ALL SELECT capture_id, {filters.ADDRESS}, '', pos * 2, 'victim to ' || ip, 'ip.src == ' || victim || ' && ip.dst == ' || ip
            FROM ips JOIN context USING (capture_id)
  UNION ALL SELECT capture_id, {filters.ADDRESS}, '', 1000, 'all suspicious addresses',
            '(' || string_agg('ip.addr == ' || ip, ' || ' ORDER BY pos) || ') && ip.addr == ' || any_value(victim)
            FROM ips JOIN context USING (capture_id) WHERE pos <= 10 GROUP BY 1
  UNION ALL SELECT capture_id, {filters.DOMAIN}, '', pos, 'lookups below ' || domain, {named} FROM domains WHERE pos <= 10
  UNION ALL SELECT capture_id, {filters.DOMAIN}, '', 1000, 'all suspicious domains', string_agg({named}, ' || ' ORDER BY pos)
            FROM domains WHERE pos <= 5 GROUP BY 1
  UNION ALL SELECT capture_id, {filters.TIME}, '', t.pos, t.label, t.text FROM times
  UNION ALL SELECT capture_id, {filters.QUICK}, '', 100, 'replication', 'drsuapi' FROM present WHERE source = 'drsuapi_packet_count'
  UNION ALL SELECT capture_id, {filters.QUICK}, '', 101, 'suspicious domain', {named} FROM domains WHERE pos = 1
  UNION ALL SELECT capture_id, {filters.QUICK}, '', 102, 'best beacon', 'ip.src == ' || src || ' && ip.dst == ' || dst FROM beacons WHERE pos = 1
  UNION ALL SELECT capture_id, {filters.BEACON}, '', pos * 4 - 4 + k, CASE k WHEN 1 THEN 'all traffic ' WHEN 2 THEN 'beacon channel '
              WHEN 3 THEN 'outbound of ' ELSE 'same port, any target ' END || src || CASE k WHEN 3 THEN '' ELSE ' to ' || dst || ':' || port END,
            'ip.src == ' || src || CASE k WHEN 3 THEN ' && !ip.dst == ' || victim ELSE '' END
              || CASE WHEN k <= 2 THEN ' && ip.dst == ' || dst ELSE '' END || CASE WHEN k IN (2, 4) THEN ' && tcp.dstport == ' || port ELSE '' END
            FROM beacons JOIN context USING (capture_id), (VALUES (1), (2), (3), (4)) n(k) WHERE pos <= 5)
WHERE filter <> ''"""


@query("display_filters", filters_sql())
def display_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets, dns = adapters.packets(spark, sf_dir), adapters.dns(spark, sf_dir)
    conn = adapters.conn(spark, sf_dir).withColumn("capture_id", F.expr("concat('cap-', uid % 5)"))
    top = talkers(spark, sf_dir)
    sources = sig.scan_sources(sig.conn_rollup(conn), ports=3, hosts=20)
    signals = all_signals(spark, sf_dir)
    return filters.display_filters(
        findings(spark, sf_dir, signals), signals,
        report.primary_victim(top, inventory.hosts(packets)), inventory.captures(packets), top,
        sig.outbound_transfers(conn, floor=20_000), sig.top_parents(dns), sig.scan_candidates(sources),
        evidence.scan_evidence(conn, sources), report.controller(evidence.smb_share_evidence(adapters.smb(spark, sf_dir))),
        beacons_by_capture(spark, sf_dir),
    )
