"""Queries on rules: scores, boosts, anomalies, log rules, alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.operators import alerts as alert_ops, packets as packet_ops
from netquarry.operators import anomaly, beacon, evidence, inventory, report, scoring, sigma, signals as sig
from netquarry.plans import adapters
from netquarry.plans.catalog import ORACLES, query
from netquarry.plans.queries_names import SUSPICIOUS
from netquarry.sources.files import load_yaml
from netquarry.sources.rules import BUILTIN, load_playbooks, parse_threshold, sigma_rule

# ------------------------------------------------------------------ signals, scores


def all_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of the five captures that packets, connections, logins, shares, TLS, DNS and HTTP share."""
    packets = adapters.packets(spark, sf_dir)
    conn = adapters.spread_conn(spark, sf_dir)
    thresholds = inventory.calibrate(inventory.captures(packet_ops.packet_rollup(packets)))
    kerberos = adapters.kerberos(spark, sf_dir)
    return sig.assemble_signals(
        packets.select("capture_id").distinct(),
        sig.packet_signals(packets),
        sig.arp_conflict_signals(packets),
        sig.dcsync_signals(packets, kerberos),
        sig.dns_signals(adapters.dns(spark, sf_dir)),
        sig.http_signals(adapters.http(spark, sf_dir)),
        sig.tls_signals(adapters.ssl(spark, sf_dir), adapters.x509(spark, sf_dir)),
        sig.smb_signals(adapters.smb(spark, sf_dir)),
        sig.kerberos_signals(kerberos),
        sig.scan_signals(conn, thresholds=thresholds),
        sig.exfil_signals(conn, floor=20_000),
        beacon.external_beacon_signals(adapters.external_scores(spark, sf_dir)),
    )


# Oracles of the parts, by their catalog names; each is a complete query.
SIGNAL_PARTS = (
    "packet_signals", "arp_signals", "dns_summary", "http_summary", "tls_anomalies", "smb_lateral", "kerberos_summary",
    "scan_signals", "transfers", "external",
)
OWN_PARTS = {
    "transfers": f"""WITH {adapters.CONN_SQL}
SELECT 'cap-' || (uid % 5) AS capture_id, max(orig_bytes) AS max_outbound_bytes FROM conn WHERE orig_bytes > 20000 GROUP BY 1""",
    "external": f"""WITH {adapters.EXTERNAL_SQL}
SELECT capture_id, 1 AS rita_available, round(max(score), 4) AS rita_top_beacon_score,
       sum(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) AS rita_beacon_pairs FROM external GROUP BY 1""",
}


def signals_sql() -> str:
    """Long form (capture_id, source, value) of all signals, defaults filled, as a WITH list."""
    joins, seen, columns = "", set(), []
    for i, part in enumerate(SIGNAL_PARTS):
        joins += f"\n  LEFT JOIN ({OWN_PARTS.get(part) or ORACLES[part]}) p{i} USING (capture_id)"
    owner = {
        "packet_signals": sig.PACKET_SIGNALS,
        "arp_signals": ["arp_ip_conflict_count"],
        "dns_summary": [
            "dns_unique_query_count", "dns_avg_query_length", "dns_txt_null_ratio", "dns_nxdomain_rate",
            "dns_max_subdomain_entropy", "dns_ptr_lookup_count", "dns_suspicious_parent_count",
            "dns_singleton_suspicious_count",
        ],
        "http_summary": ["http_unique_user_agent_count", "http_plaintext_post_count", "http_base64_uri_count"],
        "tls_anomalies": ["tls_unique_ja3_count", "tls_missing_sni_count", "tls_cert_anomaly_count"],
        "smb_lateral": ["smb_admin_share_detected", "smb_lateral_host_count"],
        "kerberos_summary": [
            "kerberos_tgs_req_count", "kerberos_rc4_tgs_count", "kerberos_unique_spn_count",
            "kerberos_preauth_failed_count",
        ],
        "scan_signals": [
            "scan_candidate_count", "scan_max_unique_dst_ports", "scan_max_unique_dst_hosts", "scan_syn_only_connection_count",
            "winrm_connection_count", "inbound_scan_unique_src_count",
        ],
        "transfers": ["max_outbound_bytes"],
        "external": ["rita_available", "rita_top_beacon_score", "rita_beacon_pairs"],
    }
    for i, part in enumerate(SIGNAL_PARTS):
        for name in owner[part]:
            seen.add(name)
            columns.append(f"coalesce(CAST(p{i}.{name} AS DOUBLE), 0e0) AS {name}")
    columns += [f"0e0 AS {name}" for name in sig.REGISTRY if name not in seen]
    return f"""
wide AS (
  SELECT c.capture_id, {", ".join(columns)}
  FROM (SELECT DISTINCT 'cap-' || (l_orderkey % 5) AS capture_id FROM lineitem) c{joins}),
long AS (UNPIVOT wide ON COLUMNS(* EXCLUDE (capture_id)) INTO NAME source VALUE value)"""


def register_signals() -> None:
    @query("signals", f"WITH {signals_sql()} SELECT capture_id, source, round(value, 4) AS value FROM long")
    def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
        long = sig.signals_long(all_signals(spark, sf_dir))
        return long.select("capture_id", "source", F.round("value", 4).alias("value"))


def _text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def _number(value) -> str:
    return "NULL" if value is None else repr(float(value))


def rules_sql() -> str:
    """The built-in rule tables as VALUES, and their evaluation."""
    books = [
        d for path in sorted((BUILTIN / "playbooks").rglob("*.yaml")) for d in load_yaml(path.read_text())
    ]
    rules, gates, signals, bonuses = [], [], [], []
    for book in books:
        ttp = _text(book["ttp_id"])
        rules.append(f"({ttp}, {_text(book['category'])}, {_text(book['confidence_ceiling'])})")
        for field, minimum in (book.get("minimum_presence") or {}).items():
            gates.append(f"({ttp}, {_text(field)}, {_number(minimum)})")
        for i, s in enumerate(book["signals"]):
            op, rhs, is_bool = parse_threshold(s["threshold"])
            low_op, low_rhs, low_bool = parse_threshold(s.get("threshold_low"))
            signals.append(
                f"({ttp}, {i}, {_text(s['id'])}, {_text(s['source'])}, {_text(s['attack_category'])}, {_text(op)}, "
                f"{_number(rhs)}, {is_bool}, {s['weight']:.4f}, {_text(low_op)}, {_number(low_rhs)}, {s.get('weight_low', 0):.4f})"
            )
        for i, b in enumerate(book.get("combination_bonuses") or []):
            bonuses += [f"({ttp}, {i}, {_text(r)}, {b['bonus']:.4f})" for r in b["signals"]]

    def test(op: str, rhs: str) -> str:
        return (
            f"coalesce(CASE {op} WHEN '>=' THEN v >= {rhs} WHEN '<=' THEN v <= {rhs} WHEN '>' THEN v > {rhs} "
            f"WHEN '<' THEN v < {rhs} WHEN '==' THEN v = {rhs} END, false)"
        )

    def values(rows: list[str]) -> str:
        return "VALUES " + ",\n".join(rows)

    return f"""
rules(ttp_id, category, ceiling) AS ({values(rules)}),
gates(ttp_id, field, minimum) AS ({values(gates)}),
rule_signals(ttp_id, i, sid, source, cat, op, rhs, is_bool, weight, low_op, low_rhs, low_weight) AS ({values(signals)}),
bonuses(ttp_id, b, sid, bonus) AS ({values(bonuses)}),
skips AS (
  SELECT DISTINCT capture_id, ttp_id FROM gates g JOIN long s ON s.source = g.field WHERE s.value < g.minimum),
states AS (
  SELECT *, {test("op", "rhs")} AS strong, {test("low_op", "low_rhs")} AS weak FROM (
    SELECT s.capture_id, r.*, CASE WHEN r.is_bool THEN CAST(s.value <> 0 AS DOUBLE) ELSE s.value END AS v
    FROM rule_signals r JOIN long s ON s.source = r.source)),
fired AS (
  SELECT capture_id, ttp_id, i, sid, cat, CASE WHEN strong THEN sid ELSE sid || '_weak' END AS fired_id,
         CASE WHEN strong THEN weight ELSE low_weight END AS w
  FROM states WHERE strong OR (weak AND low_weight > 0)),
granted AS (
  SELECT f.capture_id, b.ttp_id, sum(b.bonus) AS bonus FROM (
    SELECT ttp_id, b, list(sid) AS required, max(bonus) AS bonus FROM bonuses GROUP BY 1, 2) b
  JOIN (SELECT capture_id, ttp_id, list(sid) AS got FROM fired GROUP BY 1, 2) f ON f.ttp_id = b.ttp_id
  WHERE list_has_all(f.got, b.required) GROUP BY 1, 2),
sums AS (
  SELECT capture_id, ttp_id, sum(w) AS w, count(*) AS n, count(DISTINCT cat) AS c,
         string_agg(fired_id, ',' ORDER BY i) AS ids FROM fired GROUP BY 1, 2),
raw AS (
  SELECT k.capture_id, r.ttp_id, r.category, r.ceiling, x.ttp_id IS NOT NULL AS skipped,
         CASE WHEN x.ttp_id IS NULL THEN coalesce(s.n, 0) ELSE 0 END AS n,
         CASE WHEN x.ttp_id IS NULL THEN coalesce(s.c, 0) ELSE 0 END AS c,
         CASE WHEN x.ttp_id IS NULL THEN coalesce(s.ids, '') ELSE '' END AS signals_fired,
         CASE WHEN x.ttp_id IS NULL THEN round(least(1e0, CAST(coalesce(s.w, 0) + coalesce(g.bonus, 0) AS DOUBLE)), 4)
              ELSE 0e0 END AS score
  FROM wide k CROSS JOIN rules r
  LEFT JOIN skips x ON x.capture_id = k.capture_id AND x.ttp_id = r.ttp_id
  LEFT JOIN sums s ON s.capture_id = k.capture_id AND s.ttp_id = r.ttp_id
  LEFT JOIN granted g ON g.capture_id = k.capture_id AND g.ttp_id = r.ttp_id),
leveled AS (
  SELECT *, CASE WHEN n >= 3 AND c >= 2 THEN 'HIGH' WHEN n >= 2 AND c >= 1 THEN 'MEDIUM'
                 WHEN n >= 1 THEN 'LOW' ELSE 'ANOMALY' END AS level FROM raw),
scores AS (
  SELECT *, CASE WHEN NOT skipped AND level = 'HIGH' AND ceiling = 'MEDIUM' THEN 'MEDIUM' ELSE level END AS confidence
  FROM leveled)"""


# Findings from this score on show their evidence in the queries.
SHOWN = scoring.REPORT_THRESHOLD


def evidence_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The nine evidence tables over the captures of the packet view."""
    conn, smb = adapters.spread_conn(spark, sf_dir), adapters.smb(spark, sf_dir)
    scan = evidence.scan_evidence(conn, sig.scan_sources(conn))
    return {
        "scan": scan,
        "scan_timeline": evidence.scan_timeline(scan),
        "smb_shares": evidence.smb_share_evidence(smb),
        "smb_paths": evidence.smb_paths(smb),
        "smb_files": evidence.smb_file_evidence(smb),
        "dns": evidence.dns_evidence(adapters.dns(spark, sf_dir), minimum=1.5),
        "credentials": evidence.credential_evidence(adapters.packets(spark, sf_dir)),
        "transfers": evidence.transfer_evidence(sig.outbound_transfers(conn, floor=20_000)),
        "posts": evidence.post_evidence(adapters.http(spark, sf_dir)),
    }


def register_rules() -> None:
    base = f"WITH {signals_sql()}, {rules_sql()}"

    @query("rule_scores", base + "\nSELECT capture_id, ttp_id, category, score, confidence, skipped, signals_fired FROM scores")
    def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
        scores = scoring.score_rules(all_signals(spark, sf_dir), load_playbooks(spark))
        return scores.select(
            "capture_id", "ttp_id", "category", "score", "confidence", "skipped",
            F.array_join("signals_fired", ",").alias("signals_fired"),
        )

    boosts = f"""
, {adapters.ALERTS_SQL},
alerted AS (
  SELECT DISTINCT 'cap-' || (CAST(timestamp AS BIGINT) % 5) AS capture_id, technique AS ttp_id FROM alerts WHERE technique IS NOT NULL),
confirmed AS (
  SELECT DISTINCT capture_id, 'T1021.002' AS ttp_id FROM ({ORACLES["smb_shares"]})
  UNION SELECT DISTINCT 'cap-' || (o_orderkey % 5), 'T1558.003' FROM orders
        WHERE o_orderstatus = 'F' AND (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%')),
findings AS (
  SELECT s.capture_id, s.ttp_id, s.category, a.ttp_id IS NOT NULL AS by_alert, g.ttp_id IS NOT NULL AS by_rule,
         s.score AS base_score, s.confidence AS base_confidence, s.signals_fired AS base_fired
  FROM scores s
  LEFT JOIN alerted a ON a.capture_id = s.capture_id AND a.ttp_id = s.ttp_id
  LEFT JOIN confirmed g ON g.capture_id = s.capture_id AND g.ttp_id = s.ttp_id
  WHERE NOT s.skipped AND s.score >= 0.35),
boosted AS (
  SELECT capture_id, ttp_id, category,
         least(1e0, round(least(1e0, round(base_score + CASE WHEN by_alert THEN 0.1e0 ELSE 0e0 END, 4))
               + CASE WHEN by_rule THEN 0.1e0 ELSE 0e0 END, 4)) AS score,
         CASE WHEN by_alert OR by_rule THEN 'HIGH' ELSE base_confidence END AS confidence,
         base_fired || CASE WHEN by_alert AND base_confidence <> 'HIGH' THEN ',suricata_signature_confirmed' ELSE '' END
                    || CASE WHEN by_rule THEN ',sigma_rule_confirmed' ELSE '' END AS signals_fired
  FROM findings)"""

    @query("rule_boosts", base + boosts + "\nSELECT * FROM boosted")
    def rule_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = findings(spark, sf_dir)
        return out.select(
            "capture_id", "ttp_id", "category", "score", "confidence",
            F.array_join("signals_fired", ",").alias("signals_fired"),
        )

    shown = f"""
, {adapters.CONN_SQL},
spread AS (SELECT * REPLACE ('cap-' || (uid % 5) AS capture_id) FROM conn),
scanner AS (
  SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY ports DESC, hosts DESC, src) AS r FROM (
    SELECT capture_id, orig_h AS src, count(DISTINCT resp_p) AS ports, count(DISTINCT resp_h) AS hosts,
           min(ts) AS f, max(ts) AS l FROM spread GROUP BY 1, 2)
  WHERE ports >= 15 OR hosts >= 10),
seen AS (
  SELECT capture_id, 'T1046' AS ttp_id, 'scan' AS kind, 1 AS position, printf('%s: %d ports, %d hosts', src, ports, hosts) AS line
  FROM scanner WHERE r = 1
  UNION ALL SELECT capture_id, 'T1046', 'scan_timeline', 1, printf('scan_start %.3f', f) FROM scanner WHERE r = 1
  UNION ALL SELECT capture_id, 'T1046', 'scan_timeline', 2, printf('scan_end %.3f', l) FROM scanner WHERE r = 1
  UNION ALL SELECT capture_id, 'T1046', 'scan_timeline', 3, printf('duration_secs %.3f', l - f) FROM scanner WHERE r = 1
  UNION ALL SELECT capture_id, 'T1021.002', 'smb_shares', position, path FROM ({ORACLES["smb_shares"]})
  UNION ALL SELECT capture_id, 'T1021.002', 'smb_paths', position, printf('%s (%d)', path, uses) FROM ({ORACLES["smb_paths"]})
  UNION ALL SELECT capture_id, 'T1021.002', 'smb_files', position, name FROM ({ORACLES["smb_file_evidence"]})
  UNION ALL SELECT capture_id, 'T1071.004', 'dns', position, query FROM ({ORACLES["dns_evidence"]})
  UNION ALL SELECT capture_id, 'T1040', 'credentials', position, src || ' -> ' || dst FROM ({ORACLES["credential_evidence"]})
  UNION ALL SELECT capture_id, 'T1048.003', 'posts', position, uri FROM ({ORACLES["post_evidence"]})
  UNION ALL SELECT capture_id, 'T1048.003', 'transfers', CAST(r AS INT), printf('%s -> %s: %d bytes', orig_h, resp_h, orig_bytes) FROM (
    SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY ts, uid) AS r FROM spread WHERE orig_bytes > 20000) WHERE r <= 10),
dives AS (SELECT e.* FROM seen e JOIN boosted b ON b.capture_id = e.capture_id AND b.ttp_id = e.ttp_id AND b.score >= {SHOWN})"""

    @query("finding_view", base + boosts + shown + """
, previews AS (
  SELECT capture_id, ttp_id, string_agg(kind || ': ' || line, '|' ORDER BY kind, position, line) AS evidence_preview
  FROM dives WHERE position <= 3 GROUP BY 1, 2),
numbers AS (
  SELECT capture_id, ttp_id, kind, count(*) AS n, min(line) AS line FROM dives
  WHERE kind IN ('scan', 'smb_shares', 'dns', 'credentials', 'transfers') GROUP BY 1, 2, 3),
summaries AS (
  SELECT n.capture_id, n.ttp_id, CASE kind
    WHEN 'scan' THEN (SELECT printf('%s contacted %d hosts on %d ports.', src, hosts, ports) FROM scanner s
                      WHERE s.capture_id = n.capture_id AND s.r = 1)
    WHEN 'smb_shares' THEN n || ' administrative share events shown.'
    WHEN 'dns' THEN n || printf(' high-entropy lookups shown. Maximum entropy %.2f, failure rate %.2f%%.',
                                dns_max_subdomain_entropy, dns_nxdomain_rate * 100)
    WHEN 'credentials' THEN n || ' clear-text credential events shown.'
    ELSE printf('Largest upload %d bytes, %d POST requests.', CAST(max_outbound_bytes AS BIGINT),
                CAST(http_plaintext_post_count AS BIGINT)) END AS evidence_summary
  FROM numbers n JOIN wide w ON w.capture_id = n.capture_id)
SELECT b.capture_id, b.ttp_id, score, confidence, replace(signals_fired, '_weak', '') AS signals_fired,
       evidence_summary, coalesce(evidence_preview, '') AS evidence_preview
FROM boosted b
LEFT JOIN summaries s ON s.capture_id = b.capture_id AND s.ttp_id = b.ttp_id
LEFT JOIN previews p ON p.capture_id = b.capture_id AND p.ttp_id = b.ttp_id""")
    def finding_view(spark: SparkSession, sf_dir: str) -> DataFrame:
        # The signals travel with the findings and the summaries are made of the lines: each is worked out once.
        signals, tables = all_signals(spark, sf_dir), evidence_tables(spark, sf_dir)
        signals = signals.withColumn("_signals", F.struct(*evidence.SUMMARY_SIGNALS))
        found = findings(spark, sf_dir, signals, carry=["_signals"])
        out = report.finding_view(found, lines=evidence.evidence_lines(tables, about=True), threshold=SHOWN)
        return out.select(
            "capture_id", "ttp_id", "score", "confidence", F.array_join("signals_fired", ",").alias("signals_fired"),
            "evidence_summary", F.array_join("evidence_preview", "|").alias("evidence_preview"),
        )

    @query("deep_dive", base + boosts + shown + """
SELECT capture_id, ttp_id, kind, position, line FROM dives""")
    def deep_dive(spark: SparkSession, sf_dir: str) -> DataFrame:
        """All evidence of all reported findings, from the tables of every technique that has some."""
        lines = evidence.evidence_lines(evidence_tables(spark, sf_dir))
        return evidence.of_strong(lines, findings(spark, sf_dir), SHOWN)

    @query("anomalies", base + boosts + f"""
, strong AS (
  SELECT capture_id, list(ttp_id) FILTER (score >= 0.6) AS ids, string_agg(ttp_id, ',' ORDER BY score DESC, ttp_id) AS checked
  FROM boosted GROUP BY 1),
singles AS (
  SELECT capture_id, string_agg(query, ', ' ORDER BY query) AS names FROM (
    SELECT capture_id, query, row_number() OVER (PARTITION BY capture_id ORDER BY query) AS r FROM (
      WITH {adapters.DNS_SQL} SELECT capture_id, query FROM dns GROUP BY 1, 2 HAVING count(*) = 1)
    WHERE {SUSPICIOUS}) WHERE r <= 5 GROUP BY 1),
counts AS (
  SELECT w.*, coalesce(ids, []) AS ids, coalesce(checked, '') AS checked, coalesce(names, '') AS names,
         CAST(dns_unique_query_count AS BIGINT) AS n_names, CAST(http_plaintext_post_count AS BIGINT) AS n_posts,
         CAST(scan_max_unique_dst_hosts AS BIGINT) AS n_hosts, CAST(tls_missing_sni_count AS BIGINT) AS n_tls,
         CAST(arp_gratuitous_count AS BIGINT) AS n_arp, CAST(arp_ip_conflict_count AS BIGINT) AS n_owners,
         CAST(dns_singleton_suspicious_count AS BIGINT) AS n_single
  FROM wide w LEFT JOIN strong USING (capture_id) LEFT JOIN singles USING (capture_id)),
checks AS (
  SELECT capture_id, checked, unnest([
    {{'o': 1, 'kind': 'dns_nxdomain_pattern', 'hit': dns_nxdomain_rate >= 0.2 AND NOT list_contains(ids, 'T1071.004'),
      'd': printf('%.1f', dns_nxdomain_rate * 100) || '% of lookups fail, over ' || n_names ||
           ' distinct names. Generated domains, rotating command servers or a broken client.',
      'w': 'The failure rate is at least 20% and the tunneling rule stayed below its evidence level.'}},
    {{'o': 2, 'kind': 'high_http_post_volume', 'hit': n_posts >= 50 AND NOT list_contains(ids, 'T1048.003'),
      'd': n_posts || ' POST requests in clear text. Telemetry, uploads to a command server, or collected logins.',
      'w': 'Many POST requests, but no transfer large enough for the exfiltration rule.'}},
    {{'o': 3, 'kind': 'broad_host_contact', 'hit': n_hosts >= 20 AND NOT list_contains(ids, 'T1046'),
      'd': 'One host contacted ' || n_hosts || ' destinations. Automation, rotating command servers, or reconnaissance.',
      'w': 'Below the port-scan evidence level.'}},
    {{'o': 4, 'kind': 'tls_missing_sni', 'hit': n_tls >= 5,
      'd': n_tls || ' TLS sessions name no server. Browsers always do; custom clients often do not.',
      'w': 'Client fingerprints are needed to tell known tooling apart.'}},
    {{'o': 5, 'kind': 'arp_anomaly', 'hit': n_arp >= 3 OR n_owners >= 1,
      'd': n_arp || ' unsolicited ARP announcements and ' || n_owners ||
           ' addresses with several owners. Spoofing, or misconfigured equipment.',
      'w': 'Below the poisoning evidence level; compare with the ARP tables of the network.'}},
    {{'o': 6, 'kind': 'singleton_suspicious_domains', 'hit': n_single >= 1,
      'd': n_single || ' suspicious name(s) looked up exactly once, for example ' || names || '. Too rare for the volume rules.',
      'w': 'Each name occurs once, below every volume and entropy limit.'}}]) AS c
  FROM counts)
SELECT capture_id, printf('ANO-%04d', row_number() OVER (PARTITION BY capture_id ORDER BY c.o)) AS anomaly_id,
       c.kind AS anomaly_type, c.d AS description, c.w AS reason_not_classified, checked AS ttps_checked
FROM checks WHERE c.hit""")
    def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
        dns = adapters.dns(spark, sf_dir)
        names = sig.dns_names(dns)
        assessed = scoring.assessed_captures(
            all_signals(spark, sf_dir), load_playbooks(spark), spread_alerts(spark, sf_dir), log_rule_hits(spark, sf_dir)
        )
        out = anomaly.anomalies(
            assessed,
            captures=inventory.captures(packet_ops.packet_rollup(adapters.packets(spark, sf_dir))),
            parents=sig.dns_parents(names),
            scans=sig.scan_sources(adapters.spread_conn(spark, sf_dir)).where("candidate"),
            singletons=sig.dns_singletons(names),
        )
        return out.select(
            "capture_id", "anomaly_id", "anomaly_type", "description", "reason_not_classified",
            F.array_join("ttps_checked", ",").alias("ttps_checked"),
        )


def spread_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts over the five captures of the packet view."""
    return adapters.alerts(spark, sf_dir).withColumn("capture_id", F.expr("concat('cap-', signature_id % 5)"))


def findings(
    spark: SparkSession, sf_dir: str, signals: DataFrame | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    """Findings raised by alerts and by the built-in log rules; ``carry`` as in scoring.score_rules."""
    signals = all_signals(spark, sf_dir) if signals is None else signals
    scores = scoring.score_rules(signals, load_playbooks(spark), carry=carry)
    return scoring.sweep(scores, spread_alerts(spark, sf_dir), log_rule_hits(spark, sf_dir))


def log_rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the built-in log rules in the shares and logins."""
    logs = {"smb_mapping": adapters.smb(spark, sf_dir), "kerberos": adapters.kerberos(spark, sf_dir)}
    return sigma.sigma_scan(logs, [r for r in builtin_sigma() if r.service in logs])


def builtin_sigma():
    return [
        sigma_rule(doc)
        for path in sorted((BUILTIN / "sigma").glob("*.yml"))
        for doc in load_yaml(path.read_text())
    ]


register_signals()
register_rules()

# ------------------------------------------------------------------------ log rules

# One rule per modifier and per condition form, with its meaning as SQL.
SIGMA_CASES = [
    ("dns", {"selection": {"query|contains": "EXAMPLE.COM"}, "condition": "selection"}, "contains(query, 'example.com')"),
    ("dns", {"selection": {"query|startswith": ["m.", "blog."]}, "filter": {"qtype_name": "TXT"},
             "condition": "selection and not filter"},
     "(starts_with(query, 'm.') OR starts_with(query, 'blog.')) AND qtype_name <> 'TXT'"),
    ("dns", {"sel_a": {"query|endswith": ".org"}, "sel_b": {"rcode_name": "NXDOMAIN"}, "other": {"query": "none"},
             "condition": "1 of sel_*"},
     "(query LIKE '%.org' OR rcode_name = 'NXDOMAIN')"),
    ("dns", {"selection": {"query|contains|all": ["example", "th"]}, "condition": "selection"},
     "contains(query, 'example') AND contains(query, 'th')"),
    ("dns", {"selection": {"no_such_field": "x"}, "condition": "selection"}, "false"),
    ("dns", {"selection": {"id.orig_h": "10.0.0.3"}, "condition": "selection"}, "orig_h = '10.0.0.3'"),
    ("http", {"post": {"method": "POST"}, "agent": {"user_agent": ["ua-1", "ua-2"]}, "condition": "all of them"},
     "method = 'POST' AND user_agent IN ('ua-1', 'ua-2')"),
    ("http", {"page": {"uri|re": "PAGE=[0-9]+"}, "agent": {"user_agent": "ua-1"}, "condition": "page or agent"},
     "(regexp_matches(uri, 'page=[0-9]+') OR user_agent = 'ua-1')"),
    ("http", {"page": {"uri|endswith": "*/"}, "agent": {"user_agent": "ua-3"}, "condition": "page and agent"},
     "uri LIKE '%/' AND user_agent = 'ua-3'"),
    ("http", {"first": {"method": "GET", "user_agent": "ua-4"}, "condition": "first | count() > 3"},
     "method = 'GET' AND user_agent = 'ua-4'"),
]


def sigma_case_rules():
    return [
        sigma_rule({"title": f"case {i}", "id": f"case-{i}", "level": "high" if i % 2 else "low",
                    "logsource": {"service": service}, "tags": ["attack.t1071", "attack.command-and-control"],
                    "detection": detection})
        for i, (service, detection, _) in enumerate(SIGMA_CASES)
    ]


SIGMA_SQL = f"WITH {adapters.DNS_SQL}, {adapters.HTTP_SQL}, hits AS (" + " UNION ALL ".join(
    f"SELECT 'case-{i}' AS rule_id, '{service}' AS log_type, capture_id, orig_h, ts FROM {service} WHERE {test}"
    for i, (service, _, test) in enumerate(SIGMA_CASES)
) + """),
src AS (
  SELECT rule_id, capture_id, string_agg(orig_h, ',' ORDER BY p) AS ips FROM (
    SELECT *, row_number() OVER (PARTITION BY rule_id, capture_id ORDER BY f, orig_h) AS p FROM (
      SELECT rule_id, capture_id, orig_h, min(ts) AS f FROM hits GROUP BY 1, 2, 3)) WHERE p <= 5 GROUP BY 1, 2)
"""


@query("sigma_scan", SIGMA_SQL + """
SELECT h.capture_id, h.rule_id, any_value(log_type) AS log_type, count(*) AS match_count, any_value(ips) AS sample_src_ips
FROM hits h JOIN src s ON s.rule_id = h.rule_id AND s.capture_id = h.capture_id GROUP BY 1, 2""")
def sigma_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = {"dns": adapters.dns(spark, sf_dir), "http": adapters.http(spark, sf_dir)}
    hits = sigma.sigma_scan(logs, sigma_case_rules())
    return hits.select(
        "capture_id", "rule_id", "log_type", "match_count", F.array_join("sample_src_ips", ",").alias("sample_src_ips")
    )


@query("sigma_stats", SIGMA_SQL + """
, per AS (SELECT capture_id, rule_id, count(*) AS n FROM hits GROUP BY 1, 2)
SELECT capture_id, count(*) AS rules_hit,
       CAST(sum(CASE WHEN CAST(substr(rule_id, 6) AS INT) % 2 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS high_hits,
       CAST(sum(n) AS BIGINT) AS alert_count, 'T1071' AS techniques
FROM per GROUP BY 1""")
def sigma_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = {"dns": adapters.dns(spark, sf_dir), "http": adapters.http(spark, sf_dir)}
    stats = sigma.sigma_stats(sigma.sigma_scan(logs, sigma_case_rules()))
    return stats.withColumn("techniques", F.array_join("techniques", ","))


# --------------------------------------------------------------------------- alerts


@query("alert_techniques", f"""
WITH {adapters.ALERTS_SQL}
SELECT signature, technique, count(*) AS n FROM alerts GROUP BY 1, 2""")
def alert_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.alerts(spark, sf_dir).groupBy("signature", "technique").agg(F.count("*").alias("n"))


@query("alert_stats", f"""
WITH {adapters.ALERTS_SQL}
SELECT capture_id, count(*) AS alert_count, CAST(sum(CASE WHEN severity = 1 THEN 1 ELSE 0 END) AS BIGINT) AS high_severity_count,
       string_agg(DISTINCT technique, ',' ORDER BY technique) AS unique_techniques
FROM alerts GROUP BY 1""")
def alert_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alert_ops.alert_stats(adapters.alerts(spark, sf_dir))
    return out.withColumn("unique_techniques", F.array_join("unique_techniques", ","))


@query("alert_dedup", f"""
WITH {adapters.ALERTS_SQL},
all_in_one AS (SELECT 'all' AS capture_id, * EXCLUDE (capture_id) FROM alerts),
worst AS (
  SELECT *, row_number() OVER (PARTITION BY src_ip, dst_ip, signature ORDER BY severity, timestamp) AS r,
         count(*) OVER (PARTITION BY src_ip, dst_ip, signature) AS alert_count
  FROM all_in_one)
SELECT capture_id, src_ip, dst_ip, signature, alert_count, CAST(severity AS INT) AS severity, CAST(src_port AS INT) AS src_port,
       CAST(position AS INT) AS position FROM (
  SELECT *, row_number() OVER (ORDER BY severity, alert_count DESC, src_ip, dst_ip, signature) AS position
  FROM worst WHERE r = 1) WHERE position <= 15""")
def alert_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = adapters.alerts(spark, sf_dir).withColumn("capture_id", F.lit("all"))
    return alert_ops.duplicate_alerts(alerts).select(
        "capture_id", "src_ip", "dst_ip", "signature", "alert_count", "severity", "src_port", "position"
    )
