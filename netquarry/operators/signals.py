"""Per-capture signals. Their names are the contract with the rule tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions import text
from netquarry.functions.lists import (
    HALF_OPEN_STATES,
    INBOUND_SCAN_STATES,
    WEB_SERVICE_DOMAINS,
    WINRM_PORTS,
)
from netquarry.functions.net import is_external, is_internal
from netquarry.operators.common import (
    CAPTURE,
    count_if,
    external_rows,
    internal_rows,
    not_internal_rows,
    top_k,
)
from netquarry.operators.packets import has_protocol, packet_facts, rolled


@dataclass(frozen=True)
class Signal:
    """Name and default of one signal; the default decides the type."""

    name: str
    default: int | float | bool


# Every signal and what it is when its log is absent.
REGISTRY: dict[str, Signal] = {}


def register_signal(name: str, default: int | float | bool) -> None:
    """Make a signal known, so that it is filled, assembled and open to rules."""
    REGISTRY[name] = Signal(name, default)


for _name in (
    "dns_packet_count", "dns_unique_query_count", "dns_suspicious_parent_count",
    "dns_ptr_lookup_count", "dns_base64_label_count", "dns_c2_service_lookup_count",
    "dns_singleton_suspicious_count", "http_packet_count", "http_unique_user_agent_count",
    "http_plaintext_post_count", "http_on_nonstandard_port_count", "http_base64_uri_count",
    "tls_packet_count", "tls_unique_ja3_count", "tls_cert_anomaly_count",
    "tls_missing_sni_count", "smb_packet_count", "smb_lateral_host_count",
    "icmp_packet_count", "icmp_large_payload_count", "arp_packet_count",
    "arp_gratuitous_count", "arp_ip_conflict_count", "scan_candidate_count",
    "scan_max_unique_dst_ports", "scan_max_unique_dst_hosts",
    "scan_syn_only_connection_count", "kerberos_packet_count", "kerberos_tgs_req_count",
    "kerberos_rc4_tgs_count", "kerberos_unique_spn_count", "kerberos_preauth_failed_count",
    "max_outbound_bytes", "drsuapi_packet_count", "drsuapi_attacker_source_count",
    "rdp_packet_count", "ldap_packet_count", "cldap_packet_count",
    "winrm_connection_count", "inbound_scan_unique_src_count", "rita_beacon_pairs",
):
    register_signal(_name, 0)
for _name in (
    "dns_avg_query_length", "dns_txt_null_ratio", "dns_nxdomain_rate",
    "dns_max_subdomain_entropy", "beacon_top_score", "rita_top_beacon_score",
):
    register_signal(_name, 0.0)
for _name in (
    "http_cleartext_creds_detected", "smb_admin_share_detected", "cleartext_creds_detected",
    "ftp_cleartext_detected", "rita_available",
):
    register_signal(_name, False)


# --------------------------------------------------------------------------- DNS


def dns_names(dns: DataFrame) -> DataFrame:
    """One row per (capture, query) with counts; such a table is returned as it is.

    String work is done once per distinct name; all DNS signals read this table.
    """
    if "n_nxdomain" in dns.columns:
        return dns
    return dns.groupBy(CAPTURE, "query").agg(
        F.count("*").alias("n"),
        count_if(F.col("qtype_name").isin("TXT", "NULL")).alias("n_txt_null"),
        count_if(F.col("qtype_name") == "PTR").alias("n_ptr"),
        count_if(F.col("rcode_name") == "NXDOMAIN").alias("n_nxdomain"),
    )


def _parent_key() -> Column:
    """Parent domain of names that count for parent diversity, null for the others."""
    q = F.col("query")
    return F.when(~text.is_srv(q) & ~text.is_mdns(q), text.parent_domain(q))


SUSPICIOUS_PARENT = "parent IS NOT NULL AND fqdn_count > 10 AND label_chars / fqdn_count > 15"


def dns_parents(dns: DataFrame) -> DataFrame:
    """Distinct names per parent domain; suspicious above 10 names with long first labels."""
    parents = (
        dns_names(dns)
        .groupBy(CAPTURE, _parent_key().alias("parent"))
        .agg(
            F.count("query").alias("fqdn_count"),
            F.sum(F.length(text.first_label(F.col("query")))).alias("label_chars"),
        )
        .where("parent IS NOT NULL")
    )
    return parents.select(
        CAPTURE,
        "parent",
        "fqdn_count",
        (F.col("label_chars") / F.col("fqdn_count")).alias("avg_first_label_length"),
        F.expr(SUSPICIOUS_PARENT).alias("suspicious"),
    )


def top_parents(dns: DataFrame, k: int = 20) -> DataFrame:
    return top_k(
        dns_parents(dns), [CAPTURE], [F.desc("fqdn_count"), F.asc("parent")], k, rank="position"
    )


def dns_singletons(dns: DataFrame) -> DataFrame:
    """Suspicious names looked up exactly once."""
    q = F.col("query")
    return dns_names(dns).where((F.col("n") == 1) & text.is_suspicious_name(q)).select(CAPTURE, "query")


def dns_signals(dns: DataFrame) -> DataFrame:
    """All DNS signals in one chain: names, then parent domains, then captures."""
    q, n = F.col("query"), F.col("n")
    entropy = F.when(text.entropy_eligible(q), text.shannon_entropy(text.first_label(q))).otherwise(0.0)

    def weighted(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(0))

    parents = dns_names(dns).groupBy(CAPTURE, _parent_key().alias("parent")).agg(
        F.count("query").alias("fqdn_count"),
        F.sum(F.length(text.first_label(q))).alias("label_chars"),
        F.sum("n").alias("n"),
        weighted(q.isNotNull()).alias("n_named"),
        F.sum(F.length(q) * n).alias("chars"),
        F.sum("n_txt_null").alias("n_txt_null"),
        F.sum("n_nxdomain").alias("n_nxdomain"),
        F.sum("n_ptr").alias("n_ptr"),
        F.max(entropy).alias("entropy"),
        weighted(text.has_encoded_label(q)).alias("n_encoded"),
        weighted(text.domain_in(F.lower(q), WEB_SERVICE_DOMAINS)).alias("n_service"),
        count_if((n == 1) & text.is_suspicious_name(q)).alias("n_single"),
    )
    total = F.sum("n")
    return parents.groupBy(CAPTURE).agg(
        F.sum("fqdn_count").alias("dns_unique_query_count"),
        F.coalesce(F.try_divide(F.sum("chars"), F.sum("n_named")), F.lit(0.0)).alias("dns_avg_query_length"),
        F.round(F.sum("n_txt_null") / total, 4).alias("dns_txt_null_ratio"),
        F.round(F.sum("n_nxdomain") / total, 4).alias("dns_nxdomain_rate"),
        F.round(F.max("entropy"), 4).alias("dns_max_subdomain_entropy"),
        F.sum("n_ptr").alias("dns_ptr_lookup_count"),
        F.sum("n_encoded").alias("dns_base64_label_count"),
        F.sum("n_service").alias("dns_c2_service_lookup_count"),
        F.sum("n_single").alias("dns_singleton_suspicious_count"),
        count_if(F.expr(SUSPICIOUS_PARENT)).alias("dns_suspicious_parent_count"),
    )


# -------------------------------------------------------------------------- HTTP


def http_signals(http: DataFrame) -> DataFrame:
    return http.groupBy(CAPTURE).agg(
        F.count_distinct("user_agent").alias("http_unique_user_agent_count"),
        count_if(F.col("method") == "POST").alias("http_plaintext_post_count"),
        count_if(text.has_b64_run(F.col("uri"))).alias("http_base64_uri_count"),
    )


def post_destinations(http: DataFrame) -> DataFrame:
    """Responders of POST requests, one row each."""
    return http.where("method = 'POST' AND resp_h IS NOT NULL").select(CAPTURE, F.col("resp_h").alias("ip")).distinct()


def http_odd_port_requests(http: DataFrame) -> DataFrame:
    """Requests to other ports than 80 and 8080, for captures without packet fields."""
    return http.groupBy(CAPTURE).agg(
        count_if(~F.col("resp_p").isin(80, 8080)).alias("http_request_odd_port_count")
    )


# --------------------------------------------------------------------------- TLS


def _self_signed(x509: DataFrame) -> DataFrame:
    return x509.where("certificate_subject = certificate_issuer")


def tls_signals(ssl: DataFrame, x509: DataFrame) -> DataFrame:
    """TLS signals. Certificate anomalies come from the validation status where the log has
    one, and from self-signed certificates otherwise; a missing status counts as not ok."""
    sni = F.col("server_name")
    sessions = ssl.groupBy(CAPTURE).agg(
        F.count_distinct("ja3").alias("tls_unique_ja3_count"),
        count_if(sni.isNull() | (sni == "")).alias("tls_missing_sni_count"),
        F.count("validation_status").alias("with_status"),
        count_if(~F.col("validation_status").eqNullSafe("ok")).alias("not_ok"),
        F.count("cert_chain_fps").alias("with_chain"),
    )
    certs = _self_signed(x509).groupBy(CAPTURE).agg(
        F.count("*").alias("self_signed"), F.count("fingerprint").alias("with_fingerprint")
    )
    by_cert = F.expr("with_chain > 0 AND with_fingerprint > 0")
    return sessions.join(certs, CAPTURE, "left").select(
        CAPTURE,
        "tls_unique_ja3_count",
        "tls_missing_sni_count",
        F.when(F.col("with_status") > 0, F.col("not_ok"))
        .when(by_cert, F.col("self_signed"))
        .otherwise(0)
        .alias("tls_cert_anomaly_count"),
    )


def tls_anomaly_ips(ssl: DataFrame, x509: DataFrame) -> DataFrame:
    """Servers behind the certificate anomalies.

    Sessions are reduced to distinct (server, fingerprint) before the join on the
    fingerprint, so a certificate seen in most sessions does not pile up in one task.
    """
    servers = ssl.groupBy(CAPTURE, F.col("resp_h").alias("ip")).agg(
        F.count("validation_status").alias("with_status"),
        count_if(~F.col("validation_status").eqNullSafe("ok")).alias("not_ok"),
    )
    status = servers.groupBy(CAPTURE).agg((F.sum("with_status") > 0).alias("has_status"))
    fingerprints = _self_signed(x509).where("fingerprint IS NOT NULL").select(CAPTURE, "fingerprint").distinct()
    presented = (
        ssl.where("resp_h <> ''")
        .select(CAPTURE, F.col("resp_h").alias("ip"), F.explode("cert_chain_fps").alias("fingerprint"))
        .distinct()
    )
    by_cert = presented.join(fingerprints, [CAPTURE, "fingerprint"], "left_semi").select(
        CAPTURE, "ip", F.lit(False).alias("by_status")
    )
    by_status = servers.where("not_ok > 0 AND ip IS NOT NULL").select(CAPTURE, "ip", F.lit(True).alias("by_status"))
    return (
        by_status.unionByName(by_cert)
        .distinct()
        .join(status, CAPTURE)
        .where("by_status = has_status")
        .select(CAPTURE, "ip")
    )


def tls_sessions(ssl: DataFrame, k: int = 50) -> DataFrame:
    """First sessions of each capture."""
    rows = ssl.select(CAPTURE, "ts", "uid", "orig_h", "resp_h", "server_name", "ja3", "ja3s", "version")
    return top_k(rows, [CAPTURE], [F.asc("ts"), F.asc("uid")], k)


# --------------------------------------------------------------------------- SMB


def smb_signals(smb_mapping: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Use of administrative shares, and internal targets of internal hosts.

    Paths are tested once each, in a sum of their uses: an aggregate that ignores duplicates would test every row.
    """
    paths = smb_mapping.groupBy(CAPTURE, "path").agg(F.count("*").alias("n"))
    admin = F.sum(F.when(text.is_admin_share(F.col("path")), F.col("n")).otherwise(0)) > 0
    shares = paths.groupBy(CAPTURE).agg(admin.alias("smb_admin_share_detected"))
    pairs = smb_mapping.select(CAPTURE, "orig_h", "resp_h").distinct()
    lateral = internal_rows(internal_rows(pairs, "orig_h", hosts), "resp_h", hosts)
    counts = lateral.groupBy(CAPTURE).agg(F.count_distinct("resp_h").alias("smb_lateral_host_count"))
    return shares.join(counts, CAPTURE, "left").na.fill(0, ["smb_lateral_host_count"])


# ------------------------------------------------------------------- connections


def conn_rollup(conn: DataFrame) -> DataFrame:
    """Connections reduced to one row per (capture, source, destination, port).

    The connection table is the largest one. This reduction combines on the map side and
    has no skewed key; every scan signal is computed from it. A table that is already
    reduced is returned as it is, so a caller with several uses persists it once.
    """
    if "n_half_open" in conn.columns:
        return conn
    state = F.col("conn_state")
    return conn.groupBy(CAPTURE, "orig_h", "resp_h", "resp_p").agg(
        F.count("*").alias("n"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.max(F.coalesce("orig_bytes", F.lit(0))).alias("max_orig_bytes"),
        count_if(state.isin(*HALF_OPEN_STATES)).alias("n_half_open"),
        count_if(state.isin(*INBOUND_SCAN_STATES)).alias("n_inbound_state"),
    )


# Used where a capture has no calibrated thresholds.
DEFAULT_SCAN_PORTS = 15
DEFAULT_SCAN_HOSTS = 10
EXFIL_FLOOR = 10_000_000


def scan_sources(
    conn: DataFrame,
    thresholds: DataFrame | None = None,
    ports: int = DEFAULT_SCAN_PORTS,
    hosts: int = DEFAULT_SCAN_HOSTS,
) -> DataFrame:
    """Distinct ports and targets per source, with the candidate flag."""
    sources = (
        conn_rollup(conn)
        .where("orig_h IS NOT NULL")
        .groupBy(CAPTURE, F.col("orig_h").alias("src"))
        .agg(
            F.count_distinct("resp_p").alias("unique_dst_ports"),
            F.count_distinct("resp_h").alias("unique_dst_hosts"),
            F.sum("n").alias("total_connections"),
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
        )
    )
    return _with_candidates(sources, thresholds, ports, hosts)


def _with_candidates(
    sources: DataFrame, thresholds: DataFrame | None, ports: int, hosts: int
) -> DataFrame:
    port_limit, host_limit = F.lit(ports), F.lit(hosts)
    if thresholds is not None:
        limits = thresholds.select(CAPTURE, "scan_unique_dst_ports", "scan_unique_dst_hosts")
        sources = sources.join(limits, CAPTURE, "left")
        port_limit = F.coalesce("scan_unique_dst_ports", port_limit)
        host_limit = F.coalesce("scan_unique_dst_hosts", host_limit)
    candidate = (F.col("unique_dst_ports") >= port_limit) | (F.col("unique_dst_hosts") >= host_limit)
    return sources.withColumn("candidate", candidate).drop(
        "scan_unique_dst_ports", "scan_unique_dst_hosts"
    )


def scan_candidates(sources: DataFrame, k: int = 10) -> DataFrame:
    order = [F.desc("unique_dst_ports"), F.desc("unique_dst_hosts"), F.asc("src")]
    return top_k(sources.where("candidate"), [CAPTURE], order, k, rank="position")


def scan_summary(sources: DataFrame) -> DataFrame:
    """Candidate count, and maxima over all sources."""
    return sources.groupBy(CAPTURE).agg(
        count_if(F.col("candidate")).alias("scan_candidate_count"),
        F.max("unique_dst_ports").alias("scan_max_unique_dst_ports"),
        F.max("unique_dst_hosts").alias("scan_max_unique_dst_hosts"),
    )


INBOUND_PORTS = 5


def inbound_scanners(
    conn: DataFrame, hosts: DataFrame | None = None, min_ports: int = INBOUND_PORTS
) -> DataFrame:
    """External sources with unanswered connections to many ports of internal hosts."""
    tried = conn_rollup(conn).where("n_inbound_state > 0 AND orig_h IS NOT NULL")
    tried = internal_rows(not_internal_rows(tried, "orig_h", hosts), "resp_h", hosts)
    return (
        tried.groupBy(CAPTURE, F.col("orig_h").alias("src"))
        .agg(F.count_distinct("resp_p").alias("unique_ports"))
        .where(F.col("unique_ports") >= min_ports)
    )


def scan_signals(
    conn: DataFrame, hosts: DataFrame | None = None, thresholds: DataFrame | None = None
) -> DataFrame:
    """Scan, half-open, WinRM and inbound-scan signals, in one chain over the reduction.

    With an explicit host table the inbound scanners are found by joins instead.
    """
    src, dst, n = F.col("orig_h"), F.col("resp_h"), F.col("n")
    inbound = (F.col("n_inbound_state") > 0) & ~is_internal(src) & is_internal(dst)
    rollup = conn_rollup(conn).withColumn("inbound_p", F.when(inbound, F.col("resp_p")))
    sources = rollup.groupBy(CAPTURE, src.alias("src")).agg(
        F.count_distinct("resp_p").alias("unique_dst_ports"),
        F.count_distinct("resp_h").alias("unique_dst_hosts"),
        F.count_distinct("inbound_p").alias("inbound_ports"),
        F.sum("n_half_open").alias("n_half_open"),
        F.sum(F.when(F.col("resp_p").isin(*WINRM_PORTS), n).otherwise(0)).alias("n_winrm"),
    )
    sources = _with_candidates(sources, thresholds, DEFAULT_SCAN_PORTS, DEFAULT_SCAN_HOSTS)
    named = F.col("src").isNotNull()
    zero = F.lit(0).cast("bigint")
    out = sources.groupBy(CAPTURE).agg(
        F.sum("n_half_open").alias("scan_syn_only_connection_count"),
        F.sum("n_winrm").alias("winrm_connection_count"),
        count_if(named & F.col("candidate")).alias("scan_candidate_count"),
        F.coalesce(F.max(F.when(named, F.col("unique_dst_ports"))), zero).alias("scan_max_unique_dst_ports"),
        F.coalesce(F.max(F.when(named, F.col("unique_dst_hosts"))), zero).alias("scan_max_unique_dst_hosts"),
        count_if(named & (F.col("inbound_ports") >= INBOUND_PORTS)).alias("inbound_scan_unique_src_count"),
    )
    if hosts is None:
        return out
    listed = inbound_scanners(conn, hosts).groupBy(CAPTURE).agg(
        F.count("*").alias("inbound_scan_unique_src_count")
    )
    return out.drop("inbound_scan_unique_src_count").join(listed, CAPTURE, "left").na.fill(0)


def outbound_transfers(
    conn: DataFrame,
    hosts: DataFrame | None = None,
    thresholds: DataFrame | None = None,
    floor: int = EXFIL_FLOOR,
) -> DataFrame:
    """Internal to external connections above the byte threshold of their capture, or ``floor`` where it has none.

    The smallest threshold there is filters the scan; only the rows left meet the
    thresholds of their capture.
    """
    columns = [CAPTURE, "uid", "ts", "orig_h", "resp_h", "resp_p", "orig_bytes", "proto"]
    least = F.lit(floor)
    if thresholds is not None:
        least = F.least(least, F.coalesce(thresholds.agg(F.min("exfil_bytes_threshold")).scalar(), least))
    big = conn.where(F.col("orig_bytes") > least).select(*columns)
    big = external_rows(internal_rows(big, "orig_h", hosts), "resp_h", hosts)
    if thresholds is not None:
        limits = thresholds.select(CAPTURE, "exfil_bytes_threshold")
        big = big.join(limits, CAPTURE, "left").where(
            F.col("orig_bytes") > F.coalesce("exfil_bytes_threshold", F.lit(floor))
        ).drop("exfil_bytes_threshold")
    return big


def first_transfers(transfers: DataFrame, k: int = 10) -> DataFrame:
    return top_k(transfers, [CAPTURE], [F.asc("ts"), F.asc("uid")], k, rank="position")


def exfil_signals(
    conn: DataFrame,
    hosts: DataFrame | None = None,
    thresholds: DataFrame | None = None,
    floor: int = EXFIL_FLOOR,
) -> DataFrame:
    """Largest upload over all connections, for captures with at least one large transfer.

    A capture has one if its largest internal to external upload passes the threshold, so
    two maxima per capture are enough.
    """
    rollup = conn_rollup(conn)
    if hosts is None:
        outward = is_internal(F.col("orig_h")) & is_external(F.col("resp_h"))
        peaks = rollup.groupBy(CAPTURE).agg(
            F.max("max_orig_bytes").alias("max_outbound_bytes"),
            F.max(F.when(outward, F.col("max_orig_bytes"))).alias("peak"),
        )
    else:
        outward = external_rows(internal_rows(rollup, "orig_h", hosts), "resp_h", hosts)
        peak = outward.groupBy(CAPTURE).agg(F.max("max_orig_bytes").alias("peak"))
        peaks = rollup.groupBy(CAPTURE).agg(F.max("max_orig_bytes").alias("max_outbound_bytes"))
        peaks = peaks.join(peak, CAPTURE, "left")
    limit = F.lit(floor)
    if thresholds is not None:
        peaks = peaks.join(thresholds.select(CAPTURE, "exfil_bytes_threshold"), CAPTURE, "left")
        limit = F.coalesce("exfil_bytes_threshold", limit)
    return peaks.where(F.col("peak") > limit).select(CAPTURE, "max_outbound_bytes")


# ----------------------------------------------------------------------- packets


def _frames(*names: str) -> Column:
    return F.coalesce(F.sum(F.when(has_protocol(*names), F.col("n"))), F.lit(0).cast("bigint"))


def _marked(mark: str) -> Column:
    return F.coalesce(F.sum(mark), F.lit(0).cast("bigint"))


PACKET_SIGNALS = (
    "dns_packet_count", "http_packet_count", "tls_packet_count", "smb_packet_count",
    "arp_packet_count", "kerberos_packet_count", "icmp_packet_count", "drsuapi_packet_count",
    "rdp_packet_count", "ldap_packet_count", "cldap_packet_count", "arp_gratuitous_count",
    "icmp_large_payload_count", "http_on_nonstandard_port_count",
    "http_cleartext_creds_detected", "cleartext_creds_detected", "ftp_cleartext_detected",
)


def packet_aggregates() -> dict[str, Column]:
    """Signals that are sums over the packet table or its reduction."""
    return {
        "dns_packet_count": _frames("dns"),
        "http_packet_count": _frames("http"),
        "tls_packet_count": _frames("tls"),
        "smb_packet_count": _frames("smb2", "smb"),
        "arp_packet_count": _frames("arp"),
        "kerberos_packet_count": _frames("kerberos"),
        "icmp_packet_count": _frames("icmp"),
        "drsuapi_packet_count": _frames("drsuapi"),
        "rdp_packet_count": _frames("rdp"),
        "ldap_packet_count": _frames("ldap"),
        "cldap_packet_count": _frames("cldap"),
        "arp_gratuitous_count": _marked("n_gratuitous"),
        "icmp_large_payload_count": _marked("n_large_icmp"),
        "http_on_nonstandard_port_count": _marked("n_odd_http"),
        "http_cleartext_creds_detected": _marked("n_authorized") > 0,
        "cleartext_creds_detected": _marked("n_authorized") + _marked("n_ftp_login") > 0,
        "ftp_cleartext_detected": _marked("n_ftp_login") > 0,
    }


def packet_signals(packets: DataFrame) -> DataFrame:
    """All packet signals in one pass."""
    return _packet_subset(packets, PACKET_SIGNALS)


def _packet_subset(packets: DataFrame, names: tuple[str, ...]) -> DataFrame:
    all_of = packet_aggregates()
    return rolled(packets).groupBy(CAPTURE).agg(*[all_of[n].alias(n) for n in names])


def cleartext_signals(packets: DataFrame) -> DataFrame:
    """Credentials sent in the clear, with the protocols they were seen in."""
    names = ("http_cleartext_creds_detected", "cleartext_creds_detected", "ftp_cleartext_detected")
    protocols = F.array_compact(
        F.array(
            F.when(F.col("http_cleartext_creds_detected"), "http-basic-auth"),
            F.when(F.col("ftp_cleartext_detected"), "ftp"),
        )
    )
    return _packet_subset(packets, names).withColumn("cleartext_proto_list", protocols)


def icmp_signals(packets: DataFrame) -> DataFrame:
    return _packet_subset(packets, ("icmp_packet_count", "icmp_large_payload_count"))


def arp_conflicts(packets: DataFrame) -> DataFrame:
    """Addresses claimed by more than one hardware address."""
    return (
        packet_facts(packets, "arp")
        .groupBy(CAPTURE, F.col("a").alias("ip"))
        .agg(F.count("*").alias("mac_count"))
        .where("mac_count > 1")
    )


def arp_signals(packets: DataFrame) -> DataFrame:
    counts = _packet_subset(packets, ("arp_packet_count", "arp_gratuitous_count"))
    conflicts = arp_conflicts(packets).groupBy(CAPTURE).agg(F.count("*").alias("arp_ip_conflict_count"))
    return counts.join(conflicts, CAPTURE, "left").na.fill(0, ["arp_ip_conflict_count"])


def arp_conflict_signals(packets: DataFrame) -> DataFrame:
    return arp_conflicts(packets).groupBy(CAPTURE).agg(F.count("*").alias("arp_ip_conflict_count"))


def kerberos_signals(kerberos: DataFrame) -> DataFrame:
    tgs = F.col("request_type") == "TGS"
    return kerberos.groupBy(CAPTURE).agg(
        count_if(tgs).alias("kerberos_tgs_req_count"),
        count_if(tgs & F.lower("cipher").contains("rc4")).alias("kerberos_rc4_tgs_count"),
        F.count_distinct(F.when(tgs, F.col("service"))).alias("kerberos_unique_spn_count"),
        count_if(F.col("error_msg").contains("KDC_ERR_PREAUTH_FAILED")).alias("kerberos_preauth_failed_count"),
    )


def replication_sources(packets: DataFrame, kerberos: DataFrame) -> DataFrame:
    """Senders of replication traffic that never answered Kerberos, hence no controllers."""
    senders = packet_facts(packets, "replication").select(CAPTURE, F.col("a").alias("ip"))
    controllers = kerberos.where("resp_h IS NOT NULL").select(CAPTURE, F.col("resp_h").alias("ip")).distinct()
    return senders.join(controllers, [CAPTURE, "ip"], "left_anti")


def dcsync_signals(packets: DataFrame, kerberos: DataFrame) -> DataFrame:
    return replication_sources(packets, kerberos).groupBy(CAPTURE).agg(
        F.count("*").alias("drsuapi_attacker_source_count")
    )


# ---------------------------------------------------------------------- assembly


def assemble_signals(captures: DataFrame, *parts: DataFrame) -> DataFrame:
    """One wide row per capture; a signal without data takes its default, never null.

    All parts are aggregates by capture: they are stacked and reduced once, without a join
    for each. A signal that two parts have comes from the first.
    """
    kinds = {bool: "boolean", int: "bigint", float: "double"}
    present: set[str] = set()
    rows = [captures.select(CAPTURE, F.lit(True).alias("_known"))]
    for part in parts:
        names = [c for c in part.columns if c in REGISTRY and c not in present]
        typed = [F.col(c).cast(kinds[type(REGISTRY[c].default)]).alias(c) for c in names]
        rows.append(part.select(CAPTURE, *typed))
        present |= set(names)
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    out = stacked.groupBy(CAPTURE).agg(
        F.max("_known").alias("_known"), *[F.max(c).alias(c) for c in REGISTRY if c in present]
    ).where("_known")
    columns = []
    for name, signal in REGISTRY.items():
        default = F.lit(signal.default).cast(kinds[type(signal.default)])
        value = F.coalesce(F.col(name), default) if name in present else default
        columns.append(value.alias(name))
    return out.select(CAPTURE, *columns)


def signals_long(signals: DataFrame) -> DataFrame:
    """(capture, source, value) rows; booleans are 1 and 0."""
    names = [c for c in signals.columns if c != CAPTURE]
    wide = signals.select(CAPTURE, *[F.col(c).cast("double").alias(c) for c in names])
    return wide.unpivot([CAPTURE], names, "source", "value")


