"""Queries on the packet view: protocols, conversations, host tables, packet signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.operators import evidence, inventory, signals as sig
from netquarry.plans import adapters
from netquarry.plans.catalog import query

PACKETS = f"WITH {adapters.PACKETS_SQL}"

HISTOGRAM_SQL = """
, chain AS (
  SELECT capture_id, frame_len, unnest(['frame', 'eth', 'ip', transport, app]) AS protocol FROM packets),
histogram AS (
  SELECT capture_id, protocol, count(*) AS frames, CAST(sum(frame_len) AS BIGINT) AS bytes FROM chain GROUP BY 1, 2)
"""


@query("protocol_histogram", PACKETS + HISTOGRAM_SQL + "SELECT * FROM histogram")
def protocol_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.protocol_histogram(adapters.packets(spark, sf_dir))


@query("visibility", PACKETS + HISTOGRAM_SQL + """
SELECT capture_id, round(100 - e, 1) AS visibility_pct, e AS encrypted_pct FROM (
  SELECT capture_id, round(least(sum(CASE WHEN protocol IN ('tls', 'quic') THEN bytes ELSE 0 END) * 100e0
         / max(CASE WHEN protocol = 'frame' THEN bytes END), 100e0), 1) AS e FROM histogram GROUP BY 1)""")
def visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.visibility(inventory.protocol_histogram(adapters.packets(spark, sf_dir)))


CONVERSATIONS_SQL = """
, pairs AS (
  SELECT capture_id, least(ip_src, ip_dst) AS low, greatest(ip_src, ip_dst) AS high,
         arg_min(ip_src, frame_no) AS src, count(*) AS frames_total, CAST(sum(frame_len) AS BIGINT) AS bytes_total,
         min(ts) AS first_ts, max(ts) AS last_ts FROM packets GROUP BY 1, 2, 3),
starts AS (SELECT capture_id, min(ts) AS start FROM packets GROUP BY 1),
directed AS (
  SELECT p.capture_id, p.src, CASE WHEN p.src = p.low THEN p.high ELSE p.low END AS dst, p.frames_total, p.bytes_total,
         p.first_ts - s.start AS rel_start, p.last_ts - p.first_ts AS duration_secs
  FROM pairs p JOIN starts s USING (capture_id)),
forward AS (
  SELECT d.capture_id, d.src, d.dst, count(*) AS frames_fwd, CAST(sum(k.frame_len) AS BIGINT) AS bytes_fwd
  FROM directed d JOIN packets k ON k.capture_id = d.capture_id AND k.ip_src = d.src AND k.ip_dst = d.dst GROUP BY 1, 2, 3),
convs AS (
  SELECT d.capture_id, d.src, d.dst, f.frames_fwd, f.bytes_fwd, d.frames_total - f.frames_fwd AS frames_back,
         d.bytes_total - f.bytes_fwd AS bytes_back, d.frames_total, d.bytes_total, d.rel_start, d.duration_secs,
         CASE WHEN d.dst LIKE '10.%' THEN 'internal_to_internal' ELSE 'internal_to_external' END AS direction
  FROM directed d JOIN forward f USING (capture_id, src, dst))
"""


@query("conversations", PACKETS + CONVERSATIONS_SQL + "SELECT * FROM convs")
def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.classify_conversations(inventory.conversations(adapters.packets(spark, sf_dir)))


@query("top_talkers", PACKETS + CONVERSATIONS_SQL + """
SELECT capture_id, src, dst, bytes_total, CAST(position AS INT) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY bytes_total DESC, src, dst) AS position
  FROM convs) WHERE position <= 20""")
def top_talkers(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = adapters.packets(spark, sf_dir)
    top = inventory.from_start(inventory.top_talkers(inventory.timed_conversations(packets)), packets)
    return top.select("capture_id", "src", "dst", "bytes_total", "position")


CAPTURES_SQL = CONVERSATIONS_SQL + """
, totals AS (
  SELECT capture_id, count(*) AS total_packets, CAST(sum(frame_len) + 16 * count(*) + 24 AS BIGINT) AS file_size_bytes,
         min(ts) AS start_ts, max(ts) AS end_ts FROM packets GROUP BY 1),
flows AS (SELECT capture_id, count(*) AS total_flows, max(rel_start + duration_secs) AS duration_secs FROM convs GROUP BY 1),
ips AS (SELECT capture_id, ip_src AS ip FROM packets UNION SELECT capture_id, ip_dst FROM packets),
counts AS (
  SELECT capture_id, count(*) AS host_count,
         CAST(sum(CASE WHEN ip LIKE '10.%' THEN 1 ELSE 0 END) AS BIGINT) AS internal_count FROM ips GROUP BY 1),
captures AS (SELECT * FROM totals JOIN flows USING (capture_id) JOIN counts USING (capture_id))
"""


@query("captures", PACKETS + CAPTURES_SQL + "SELECT * FROM captures")
def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inventory.captures(adapters.packets(spark, sf_dir))
    return out.drop("visibility_pct", "encrypted_pct", "protocols_present")


@query("calibration", PACKETS + CAPTURES_SQL + """
SELECT capture_id, greatest(5, CAST(floor(duration_secs / 300) AS BIGINT)) AS beacon_min_connections,
       least(duration_secs * 0.3e0, 3600e0) AS beacon_min_duration_secs,
       greatest(5, CAST(floor(internal_count * 0.3e0) AS BIGINT)) AS lateral_new_internal_connections,
       CAST(20 AS BIGINT) AS scan_unique_dst_ports,
       greatest(10, CAST(floor(host_count * 0.2e0) AS BIGINT)) AS scan_unique_dst_hosts,
       greatest(10000000, CAST(floor(file_size_bytes * 0.05e0) AS BIGINT)) AS exfil_bytes_threshold,
       false AS skip_dns_ttps, true AS skip_smb_ttps, false AS skip_kerberos_ttps, false AS skip_http_ttps,
       false AS skip_tls_ttps, false AS skip_icmp_ttps
FROM captures""")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds; the view has smb2 but no smb frames, so the SMB flag is set."""
    return inventory.calibrate(inventory.captures(adapters.packets(spark, sf_dir)))


@query("first_seen", PACKETS + """
SELECT 'mac' AS kind, capture_id, eth_src AS key, ip_src AS value, min(frame_no) AS first_frame
FROM packets GROUP BY capture_id, eth_src, ip_src
UNION ALL
SELECT 'name', capture_id, dns_a, arg_min(dns_qry_name, frame_no), CAST(0 AS BIGINT)
FROM packets WHERE dns_is_response GROUP BY capture_id, dns_a
UNION ALL
SELECT 'os', capture_id, ip_src, CASE WHEN t <= 32 THEN 'windows-old/printer' WHEN t <= 64 THEN 'linux/macos'
       WHEN t <= 128 THEN 'windows' ELSE 'network-device' END, CAST(0 AS BIGINT)
FROM (SELECT capture_id, ip_src, arg_min(ip_ttl, frame_no) AS t FROM packets GROUP BY 1, 2)""")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = adapters.packets(spark, sf_dir)

    def rows(df: DataFrame, kind: str, key: str, value: str, frame: str) -> DataFrame:
        return df.select(
            F.lit(kind).alias("kind"), "capture_id", F.col(key).alias("key"), F.col(value).alias("value"),
            F.expr(frame).alias("first_frame"),
        )

    macs = rows(inventory.mac_ip(packets), "mac", "mac", "ip", "first_frame")
    names = rows(inventory.hostnames(packets), "name", "ip", "hostname", "0L")
    systems = rows(inventory.os_hints(packets), "os", "ip", "os_hint", "0L")
    return macs.unionByName(names).unionByName(systems)


@query("odd_ports", PACKETS + """
, odd AS (
  SELECT capture_id, frame_no, CASE WHEN app = 'http' THEN 'http' ELSE 'dns' END AS proto, ip_src AS src, ip_dst AS dst,
         CASE WHEN app = 'http' THEN tcp_dstport ELSE udp_dstport END AS port
  FROM packets WHERE (app = 'http' AND tcp_dstport NOT IN (80, 8080, 443)) OR (app = 'dns' AND udp_dstport <> 53))
SELECT capture_id, frame_no, proto, src, dst, CAST(port AS INT) AS port FROM (
  SELECT *, row_number() OVER (PARTITION BY capture_id, proto ORDER BY frame_no) AS r FROM odd) WHERE r <= 20""")
def odd_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.odd_ports(adapters.packets(spark, sf_dir))


def _frames(name: str, app: str) -> str:
    return f"CAST(sum(CASE WHEN app = '{app}' THEN 1 ELSE 0 END) AS BIGINT) AS {name}"


@query("packet_signals", PACKETS + f"""
SELECT capture_id, {_frames('dns_packet_count', 'dns')}, {_frames('http_packet_count', 'http')},
       {_frames('tls_packet_count', 'tls')}, {_frames('smb_packet_count', 'smb2')},
       {_frames('arp_packet_count', 'arp')}, {_frames('kerberos_packet_count', 'kerberos')},
       {_frames('icmp_packet_count', 'icmp')}, {_frames('drsuapi_packet_count', 'drsuapi')},
       {_frames('rdp_packet_count', 'rdp')}, {_frames('ldap_packet_count', 'ldap')},
       {_frames('cldap_packet_count', 'cldap')},
       CAST(sum(CASE WHEN arp_opcode = 1 AND arp_src_ip = arp_dst_ip THEN 1 ELSE 0 END) AS BIGINT) AS arp_gratuitous_count,
       CAST(sum(CASE WHEN app = 'icmp' AND data_len > 512 THEN 1 ELSE 0 END) AS BIGINT) AS icmp_large_payload_count,
       CAST(sum(CASE WHEN app = 'http' AND tcp_dstport NOT IN (80, 8080) THEN 1 ELSE 0 END) AS BIGINT) AS http_on_nonstandard_port_count,
       coalesce(bool_or(http_authorization <> ''), false) AS http_cleartext_creds_detected,
       coalesce(bool_or(http_authorization <> ''), false) OR coalesce(bool_or(ftp_command = 'USER'), false) AS cleartext_creds_detected,
       coalesce(bool_or(ftp_command = 'USER'), false) AS ftp_cleartext_detected
FROM packets GROUP BY 1""")
def packet_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.packet_signals(adapters.packets(spark, sf_dir))


@query("cleartext_credentials", PACKETS + """
SELECT capture_id, coalesce(bool_or(http_authorization <> ''), false) AS http_cleartext_creds_detected,
       coalesce(bool_or(http_authorization <> '' OR ftp_command = 'USER'), false) AS cleartext_creds_detected,
       coalesce(bool_or(ftp_command = 'USER'), false) AS ftp_cleartext_detected,
       concat_ws(',', CASE WHEN bool_or(http_authorization <> '') THEN 'http-basic-auth' END,
                 CASE WHEN bool_or(ftp_command = 'USER') THEN 'ftp' END) AS cleartext_proto_list
FROM packets GROUP BY 1""")
def cleartext_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sig.cleartext_signals(adapters.packets(spark, sf_dir))
    return out.withColumn("cleartext_proto_list", F.array_join("cleartext_proto_list", ","))


@query("credential_evidence", PACKETS + """
SELECT capture_id, frame_no, ip_src AS src, ip_dst AS dst, http_authorization AS auth_header, CAST(position AS INT) AS position
FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY frame_no) AS position
      FROM packets WHERE http_authorization <> '') WHERE position <= 20""")
def credential_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.credential_evidence(adapters.packets(spark, sf_dir)).drop("ts")


@query("icmp_signals", PACKETS + f"""
SELECT capture_id, {_frames('icmp_packet_count', 'icmp')},
       CAST(sum(CASE WHEN app = 'icmp' AND data_len > 512 THEN 1 ELSE 0 END) AS BIGINT) AS icmp_large_payload_count
FROM packets GROUP BY 1""")
def icmp_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.icmp_signals(adapters.packets(spark, sf_dir))


@query("arp_conflicts", PACKETS + """
SELECT capture_id, arp_src_ip AS ip, count(DISTINCT arp_src_mac) AS mac_count FROM packets
GROUP BY 1, 2 HAVING count(DISTINCT arp_src_mac) > 1""")
def arp_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.arp_conflicts(adapters.packets(spark, sf_dir))


@query("arp_signals", PACKETS + f"""
, conflicts AS (
  SELECT capture_id, count(*) AS n FROM (
    SELECT capture_id, arp_src_ip FROM packets GROUP BY 1, 2 HAVING count(DISTINCT arp_src_mac) > 1) GROUP BY 1)
SELECT p.capture_id, {_frames('arp_packet_count', 'arp')},
       CAST(sum(CASE WHEN arp_opcode = 1 AND arp_src_ip = arp_dst_ip THEN 1 ELSE 0 END) AS BIGINT) AS arp_gratuitous_count,
       coalesce(max(n), 0) AS arp_ip_conflict_count
FROM packets p LEFT JOIN conflicts c ON c.capture_id = p.capture_id GROUP BY 1""")
def arp_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.arp_signals(adapters.packets(spark, sf_dir))


@query("dcsync", f"""
WITH {adapters.PACKETS_SQL}, {adapters.KERBEROS_SQL}
SELECT capture_id, count(DISTINCT ip_src) AS drsuapi_attacker_source_count FROM packets p
WHERE app = 'tls' AND NOT EXISTS (
  SELECT 1 FROM kerberos k WHERE k.capture_id = p.capture_id AND '10.0.0.' || split_part(k.resp_h, '.', 4) = p.ip_src)
GROUP BY 1""")
def dcsync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TLS stands in for replication traffic, and responders are moved into the packet network."""
    packets = adapters.packets(spark, sf_dir).withColumn(
        "protocols", F.transform("protocols", lambda p: F.when(p == "tls", "drsuapi").otherwise(p))
    )
    kerberos = adapters.kerberos(spark, sf_dir).withColumn(
        "resp_h", F.concat(F.lit("10.0.0."), F.split_part("resp_h", F.lit("."), F.lit(4)))
    )
    return sig.dcsync_signals(packets, kerberos)
