"""Signals on small tables: null rules, defaults, captures kept apart, extension."""

import pytest

from netquarry.operators import artifacts, evidence, ioc, signals as sig
from netquarry.sources import zeek


def ssl(spark, rows):
    schema = (
        "capture_id string, ts double, uid string, orig_h string, resp_h string, server_name string, ja3 string, "
        "ja3s string, version string, validation_status string, cert_chain_fps array<string>"
    )
    full = [
        (r.get("cap", "c"), float(i), f"u{i}", "10.0.0.1", r.get("ip", "1.1.1.1"), r.get("sni"), r.get("ja3"), None, "v",
         r.get("status"), r.get("chain"))
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, schema)


def x509(spark, rows):
    schema = (
        "capture_id string, fingerprint string, certificate_subject string, certificate_issuer string, "
        "certificate_not_valid_before double, certificate_not_valid_after double, certificate_key_type string, "
        "certificate_key_length int, basic_constraints_ca boolean, san_dns array<string>"
    )
    return spark.createDataFrame(
        [(r.get("cap", "c"), r.get("fp"), r.get("s"), r.get("i"), 0.0, 0.0, "rsa", 1, r.get("ca"), None) for r in rows], schema
    )


def test_missing_status_counts_as_anomaly_where_the_log_has_one(spark):
    table = ssl(spark, [{"status": "ok", "sni": "a"}, {"sni": ""}, {"status": "expired", "ip": "2.2.2.2"}])
    certs = x509(spark, [{"fp": "f", "s": "x", "i": "x"}])
    row = sig.tls_signals(table, certs).first()
    assert (row.tls_cert_anomaly_count, row.tls_missing_sni_count) == (2, 2)
    assert sorted(r.ip for r in sig.tls_anomaly_ips(table, certs).collect()) == ["1.1.1.1", "2.2.2.2"]


def test_self_signed_certificates_count_without_status(spark):
    table = ssl(spark, [{"chain": ["f", "g"], "ip": "2.2.2.2"}, {"chain": ["h"]}])
    certs = x509(spark, [{"fp": "f", "s": "x", "i": "x", "ca": True}, {"fp": "h", "s": "x", "i": "y"}, {"fp": None, "s": None, "i": None}])
    assert sig.tls_signals(table, certs).first().tls_cert_anomaly_count == 1
    assert [r.ip for r in sig.tls_anomaly_ips(table, certs).collect()] == ["2.2.2.2"]


def test_nameless_certificates_are_self_signed_in_the_table_only(spark):
    certs = {r.fingerprint: r.anomalies for r in artifacts.certificates(
        x509(spark, [{"fp": "n"}, {"fp": "a", "s": "x", "i": "x", "ca": True}]), known_bad=["a"]).collect()}
    assert certs == {"n": ["self-signed"], "a": ["known_malicious_cert"]}


def test_all_sessions_are_checked_for_fingerprints(spark):
    rows = [{"ja3": "clean", "ip": f"9.9.9.{i}"} for i in range(80)] + [{"ja3": "de350869b8c85de67a350c8d186f11e6", "ip": "6.6.6.6"}]
    assert [(r.dst_ip, r.ja3_family) for r in ioc.ja3_matches(ssl(spark, rows)).collect()] == [("6.6.6.6", "Metasploit Meterpreter")]


def test_large_transfer_needs_direction_and_size(spark):
    schema = "capture_id string, uid string, ts double, orig_h string, resp_h string, resp_p int, orig_bytes bigint, proto string, conn_state string"
    rows = [
        ("a", "1", 1.0, "10.0.0.1", "8.8.8.8", 443, 20_000_000, "tcp", "SF"),
        ("a", "2", 2.0, "10.0.0.1", "10.0.0.2", 445, 90_000_000, "tcp", "SF"),
        ("b", "3", 3.0, "10.0.0.1", "10.0.0.2", 445, 90_000_000, "tcp", "SF"),
        ("c", "4", 4.0, "10.0.0.1", "8.8.8.8", 443, 20_000_000, "tcp", "SF"),
    ]
    conn = spark.createDataFrame(rows, schema)
    limits = spark.createDataFrame([("c", 30_000_000)], "capture_id string, exfil_bytes_threshold bigint")
    assert {(r.capture_id, r.max_outbound_bytes) for r in sig.exfil_signals(conn, thresholds=limits).collect()} == {("a", 90_000_000)}
    assert [r.uid for r in sig.outbound_transfers(conn, thresholds=limits).collect()] == ["1"]
    hosts = spark.createDataFrame([("a", "10.0.0.1", True), ("a", "8.8.8.8", False), ("a", "10.0.0.2", False)],
                                  "capture_id string, ip string, is_internal boolean")
    assert [r.uid for r in sig.outbound_transfers(conn, hosts).orderBy("uid").collect()] == ["1", "2"]
    assert sig.exfil_signals(conn, hosts).first().max_outbound_bytes == 90_000_000


def test_a_threshold_below_the_usual_floor_counts(spark):
    rows = [("low", f"u{i}", 1.0, "10.0.0.1", "8.8.8.8", 443, size, "tcp") for i, size in enumerate((900_000, 5_000_000))]
    rows += [("none", "u9", 1.0, "10.0.0.1", "8.8.8.8", 443, size, "tcp") for size in (5_000_000, 50_000_000)]
    table = spark.createDataFrame(rows, "capture_id string, uid string, ts double, orig_h string, resp_h string, resp_p int, orig_bytes bigint, proto string")
    limits = spark.createDataFrame([("low", 1_000_000)], "capture_id string, exfil_bytes_threshold bigint")
    got = sig.outbound_transfers(table, thresholds=limits).collect()
    assert sorted((r.capture_id, r.orig_bytes) for r in got) == [("low", 5_000_000), ("none", 50_000_000)]
    assert sig.outbound_transfers(table, thresholds=limits.where("false")).count() == 1


def test_scan_of_null_sources(spark):
    schema = "capture_id string, ts double, orig_h string, resp_h string, resp_p int, orig_bytes bigint, conn_state string"
    conn = spark.createDataFrame([("c", 1.0, None, "10.0.0.1", p, None, "S0") for p in range(30)], schema)
    row = sig.scan_signals(conn).first()
    assert (row.scan_syn_only_connection_count, row.scan_candidate_count, row.scan_max_unique_dst_ports) == (30, 0, 0)


def test_defaults_fill_captures_without_logs(spark):
    captures = spark.createDataFrame([("a",), ("b",)], "capture_id string")
    http = zeek.empty_log(spark, "http")
    wide = sig.assemble_signals(captures, sig.http_signals(http))
    assert len(wide.columns) == len(sig.REGISTRY) + 1
    assert all(v in (0, 0.0, False) and v is not None for r in wide.collect() for k, v in r.asDict().items() if k != "capture_id")


def test_own_signal(spark):
    sig.register_signal("own_count", 0)
    try:
        captures = spark.createDataFrame([("a",), ("b",)], "capture_id string")
        part = spark.createDataFrame([("a", 7)], "capture_id string, own_count int")
        got = {r.capture_id: r.own_count for r in sig.assemble_signals(captures, part).collect()}
        assert got == {"a": 7, "b": 0}
    finally:
        del sig.REGISTRY["own_count"]


def test_evidence_for_display(spark):
    rows = [("c", 1.7e9, "u1", "10.0.0.1", "1.2.3.4", "tcp", list(range(9)))]
    table = spark.createDataFrame(rows, "capture_id string, ts double, uid string, orig_h string, resp_h string, proto string, ports array<int>")
    row = evidence.format_evidence(table).first()
    assert row.asDict() == {
        "capture_id": "c", "ts": "2023-11-14 22:13:20", "src": "10.0.0.1", "dst": "1.2.3.4",
        "ports": [0, 1, 2, 3, 4, 5], "ports_more": 3,
    }


@pytest.mark.parametrize("action, count", [("write", 1), ("READ", 0)])
def test_smb_writes(spark, action, count):
    schema = "capture_id string, ts double, orig_h string, resp_h string, path string, name string, action string, size bigint"
    table = spark.createDataFrame([("c", 1.0, "a", "b", r"\\S\x", "f", action, None)], schema)
    assert artifacts.smb_writes(artifacts.smb_events(table)).count() == count
