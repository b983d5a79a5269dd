"""Queries on logins, file shares and TLS."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.functions.lists import BAD_JA3, BAD_JA3S
from netquarry.operators import artifacts, evidence, ioc, report, signals as sig
from netquarry.plans import adapters
from netquarry.plans.catalog import query


@query("kerberos_summary", f"""
WITH {adapters.KERBEROS_SQL}
SELECT capture_id, CAST(sum(CASE WHEN request_type = 'TGS' THEN 1 ELSE 0 END) AS BIGINT) AS kerberos_tgs_req_count,
       CAST(sum(CASE WHEN request_type = 'TGS' AND lower(cipher) LIKE '%rc4%' THEN 1 ELSE 0 END) AS BIGINT) AS kerberos_rc4_tgs_count,
       count(DISTINCT CASE WHEN request_type = 'TGS' THEN service END) AS kerberos_unique_spn_count,
       CAST(sum(CASE WHEN error_msg LIKE '%KDC_ERR_PREAUTH_FAILED%' THEN 1 ELSE 0 END) AS BIGINT) AS kerberos_preauth_failed_count
FROM kerberos GROUP BY 1""")
def kerberos_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.kerberos_signals(adapters.kerberos(spark, sf_dir))


@query("smb_lateral", f"""
WITH {adapters.SMB_SQL}
SELECT capture_id, bool_or(regexp_matches(upper(path), 'ADMIN\\$|C\\$|IPC\\$')) AS smb_admin_share_detected,
       count(DISTINCT CASE WHEN resp_h LIKE '10.%' THEN resp_h END) AS smb_lateral_host_count
FROM smb GROUP BY 1""")
def smb_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.smb_signals(adapters.smb(spark, sf_dir))


@query("smb_lateral_members", f"""
WITH {adapters.SMB_SQL}
SELECT capture_id, bool_or(regexp_matches(upper(path), 'ADMIN\\$|C\\$|IPC\\$')) AS smb_admin_share_detected,
       count(DISTINCT CASE WHEN resp_h LIKE '10.%' THEN resp_h END) AS smb_lateral_host_count
FROM smb GROUP BY 1""")
def smb_lateral_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with an explicit host table, by semi joins."""
    smb = adapters.smb(spark, sf_dir)
    ends = smb.select("capture_id", F.explode(F.array("orig_h", "resp_h")).alias("ip")).distinct()
    hosts = ends.withColumn("is_internal", F.col("ip").startswith("10."))
    return sig.smb_signals(smb, hosts)


@query("smb_shares", f"""
WITH {adapters.SMB_SQL}
SELECT capture_id, uid, path, CAST(position AS INT) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY ts, uid) AS position
  FROM smb WHERE regexp_matches(upper(path), 'ADMIN\\$|C\\$|IPC\\$')) WHERE position <= 20""")
def smb_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evidence.smb_share_evidence(adapters.smb(spark, sf_dir))
    return out.select("capture_id", "uid", "path", "position")


@query("smb_paths", f"""
WITH {adapters.SMB_SQL}
SELECT capture_id, path, first_ts, uses, CAST(position AS INT) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY first_ts, path) AS position FROM (
    SELECT capture_id, path, min(ts) AS first_ts, count(*) AS uses FROM smb GROUP BY 1, 2)) WHERE position <= 10""")
def smb_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.smb_paths(adapters.smb(spark, sf_dir))


@query("smb_events", rf"""
WITH {adapters.SMB_SQL}
SELECT capture_id, ts, orig_h AS src_ip, resp_h AS dst_ip, trim(path || '\' || name, '\') AS path,
       upper(action) AS action, size AS size_bytes
FROM smb""")
def smb_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts.smb_events(adapters.smb(spark, sf_dir))


@query("smb_writes", rf"""
WITH {adapters.SMB_SQL}
SELECT capture_id, trim(path || '\' || name, '\') AS path, count(*) AS writes FROM smb WHERE action = 'write' GROUP BY 1, 2""")
def smb_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = artifacts.smb_writes(artifacts.smb_events(adapters.smb(spark, sf_dir)))
    return writes.groupBy("capture_id", "path").agg(F.count("*").alias("writes"))


@query("smb_file_evidence", f"""
WITH {adapters.SMB_SQL}
SELECT capture_id, uid, name, size, CAST(position AS INT) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY ts, uid) AS position FROM smb) WHERE position <= 20""")
def smb_file_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evidence.smb_file_evidence(adapters.smb(spark, sf_dir))
    return out.select("capture_id", "uid", "name", "size", "position")


@query("format_evidence", f"""
WITH {adapters.SMB_SQL}
SELECT capture_id, strftime(to_timestamp(1700000000 + ts) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS ts, orig_h AS src,
       resp_h AS dst, path FROM (
  SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY ts, uid) AS position
  FROM smb WHERE regexp_matches(upper(path), 'ADMIN\\$|C\\$|IPC\\$')) WHERE position <= 20""")
def format_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share evidence for display, times moved into this century."""
    out = evidence.smb_share_evidence(adapters.smb(spark, sf_dir)).withColumn("ts", F.col("ts") + 1.7e9)
    return evidence.format_evidence(out.select("capture_id", "ts", "uid", "orig_h", "resp_h", "path"))


@query("controller", f"""
WITH {adapters.SMB_SQL}
SELECT capture_id, arg_min(resp_h, uid) AS dc FROM smb WHERE regexp_matches(upper(path), 'ADMIN\\$|C\\$|IPC\\$') GROUP BY 1""")
def controller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.controller(evidence.smb_share_evidence(adapters.smb(spark, sf_dir)))


TLS_SQL = f"""
WITH {adapters.SSL_SQL}, {adapters.X509_SQL},
status AS (SELECT capture_id, count(validation_status) > 0 AS has_status FROM ssl GROUP BY 1),
self_signed AS (SELECT * FROM x509 WHERE subject = issuer)
"""


@query("tls_anomalies", TLS_SQL + """
SELECT s.capture_id, count(DISTINCT ja3) AS tls_unique_ja3_count,
       CAST(sum(CASE WHEN server_name IS NULL OR server_name = '' THEN 1 ELSE 0 END) AS BIGINT) AS tls_missing_sni_count,
       CASE WHEN any_value(has_status)
            THEN CAST(sum(CASE WHEN validation_status IS DISTINCT FROM 'ok' THEN 1 ELSE 0 END) AS BIGINT)
            ELSE (SELECT count(*) FROM self_signed x WHERE x.capture_id = s.capture_id) END AS tls_cert_anomaly_count
FROM ssl s JOIN status USING (capture_id) GROUP BY s.capture_id""")
def tls_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.tls_signals(adapters.ssl(spark, sf_dir), adapters.x509(spark, sf_dir))


@query("tls_anomaly_ips", TLS_SQL + """
SELECT DISTINCT s.capture_id, s.resp_h AS ip FROM ssl s JOIN status USING (capture_id)
WHERE (has_status AND validation_status IS DISTINCT FROM 'ok')
   OR (NOT has_status AND EXISTS (SELECT 1 FROM self_signed x WHERE x.capture_id = s.capture_id
                                  AND (x.fingerprint = s.fp1 OR x.fingerprint = s.fp2)))""")
def tls_anomaly_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.tls_anomaly_ips(adapters.ssl(spark, sf_dir), adapters.x509(spark, sf_dir))


@query("tls_sessions", TLS_SQL + """
SELECT capture_id, uid, server_name, ja3 FROM (
  SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY ts, uid) AS r FROM ssl) WHERE r <= 50""")
def tls_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.tls_sessions(adapters.ssl(spark, sf_dir)).select("capture_id", "uid", "server_name", "ja3")


@query("certificates", f"""
WITH {adapters.X509_SQL}
SELECT capture_id, fingerprint, subject, issuer, coalesce(is_ca, false) AS is_ca,
       concat_ws(',', CASE WHEN subject = issuer AND NOT is_ca THEN 'self-signed' END,
         CASE WHEN not_after > 0 AND not_before > 0 AND not_after < not_before THEN 'expired_at_capture_time' END,
         CASE WHEN NOT is_ca AND not_after - not_before > 315360000 THEN 'unusually_long_validity_leaf_cert' END,
         CASE WHEN regexp_full_match(subject, 'CN=[a-z]{{6,14}}') THEN 'generic_cn_looks_generated' END) AS anomalies
FROM x509""")
def certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = artifacts.certificates(adapters.x509(spark, sf_dir))
    return out.select(
        "capture_id", "fingerprint", "subject", "issuer", "is_ca", F.array_join("anomalies", ",").alias("anomalies")
    )


def _values(table: dict[str, str]) -> str:
    return ", ".join(f"('{h}', '{f}')" for h, f in table.items())


@query("ja3_matches", TLS_SQL + f"""
, bad3(ja3, family) AS (VALUES {_values(BAD_JA3)}),
bad3s(ja3s, family) AS (VALUES {_values(BAD_JA3S)}),
first AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, ja3, ja3s ORDER BY ts, uid) AS r
                 FROM ssl WHERE ja3 NOT IN ('', '-', 'nan')) WHERE r = 1)
SELECT f.capture_id, f.ja3, f.ja3s, b.family IS NOT NULL AS matched_bad_ja3, s.family IS NOT NULL AS matched_bad_ja3s,
       coalesce(b.family, '') AS ja3_family, coalesce(s.family, '') AS ja3s_family, f.orig_h AS src_ip,
       f.resp_h AS dst_ip, coalesce(f.server_name, '') AS server_name
FROM first f LEFT JOIN bad3 b ON b.ja3 = f.ja3 LEFT JOIN bad3s s ON s.ja3s = f.ja3s
WHERE b.family IS NOT NULL OR s.family IS NOT NULL""")
def ja3_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ioc.ja3_matches(adapters.ssl(spark, sf_dir))
