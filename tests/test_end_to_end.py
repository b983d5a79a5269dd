"""The whole analysis over a log directory of three captures that share addresses."""

import json

import pytest

from netquarry.plans.analyze import Options, analyze, read_inputs
from netquarry.schemas import PACKET_FIELDS

BASE = 1_700_000_000.0


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def ends(src, dst, port, **more):
    return {"id.orig_h": src, "id.orig_p": 50000, "id.resp_h": dst, "id.resp_p": port} | more


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("captures")
    logs, alpha, beta = root / "logs", root / "logs" / "alpha", root / "logs" / "beta"
    victim, controller, c2 = "10.0.0.5", "10.0.0.10", "203.0.113.7"

    # alpha: a beacon, a port scan, one large upload, tunneling, shares, logins, a lease.
    conn = [{"ts": BASE + 60 * i, "uid": f"b{i}"} | ends(victim, c2, 443, orig_bytes=120, conn_state="SF", proto="tcp") for i in range(120)]
    conn += [{"ts": BASE + i, "uid": f"s{i}"} | ends(victim, f"10.0.1.{i % 40}", 1000 + i, orig_bytes=0, conn_state="S0") for i in range(200)]
    conn += [{"ts": BASE + 50, "uid": "big"} | ends(victim, "198.51.100.9", 80, orig_bytes=50_000_000, conn_state="SF", proto="tcp")]
    conn += [{"ts": BASE + i, "uid": f"i{i}"} | ends("198.51.100.66", victim, 20 + i, conn_state="REJ") for i in range(6)]
    conn += [{"ts": BASE + 9, "uid": "w"} | ends(victim, controller, 5985, conn_state="SF")]
    lines(alpha / "conn.log", conn)
    label = "QWxhZGRpbjpPcGVuU2VzYW1lMTIzNDU2"
    dns = [{"ts": BASE + i, "uid": f"d{i}", "query": f"{label[i:] + label[:i]}{i:02d}.tunnel.com", "qtype_name": "TXT", "rcode_name": "NXDOMAIN"} | ends(victim, controller, 53) for i in range(12)]
    dns += [{"ts": BASE + 20, "uid": "x", "query": "whooptm.cyou", "qtype_name": "A", "rcode_name": "NOERROR"} | ends(victim, controller, 53)]
    dns += [{"ts": BASE + 21, "uid": "m", "query": "desk-five.local", "qtype_name": "A"} | ends(victim, "224.0.0.251", 5353)]
    lines(alpha / "dns.log", dns)
    lines(alpha / "http.log", [{"ts": BASE + i, "uid": f"h{i}", "method": "POST", "uri": "/x?d=" + "A1b2" * 8, "user_agent": "ua", "host": "h"} | ends(victim, c2, 80) for i in range(60)])
    lines(alpha / "ssl.log", [{"ts": BASE + i, "uid": f"t{i}", "server_name": "", "ja3": "72a589da586844d7f0818ce684948eea", "ja3s": "z", "cert_chain_fps": ["f1"]} | ends(victim, c2, 443) for i in range(6)])
    lines(alpha / "x509.log", [{"ts": BASE, "fingerprint": "f1", "certificate.subject": "CN=abcdefgh", "certificate.issuer": "CN=abcdefgh", "certificate.not_valid_before": BASE - 100, "certificate.not_valid_after": BASE - 50}])
    lines(alpha / "smb_mapping.log", [{"ts": BASE + i, "uid": f"m{i}", "path": rf"\\DC1.corp.example.com\{s}"} | ends(victim, f"10.0.0.{10 + i}", 445) for i, s in enumerate(["ADMIN$", "C$", "IPC$"])])
    lines(alpha / "smb_files.log", [{"ts": BASE, "uid": "f", "action": "write", "path": r"\\DC1\C$", "name": "tool.exe", "size": 10} | ends(victim, controller, 445)])
    lines(alpha / "kerberos.log", [{"ts": BASE + i, "uid": f"k{i}", "request_type": "TGS", "client": c, "service": f"svc{i}", "cipher": "rc4-hmac"} | ends(victim, controller, 88) for i, c in enumerate(["PC$/CORP", "alice/CORP", "bob/CORP"])])
    lines(alpha / "files.log", [{"ts": BASE, "fuid": "F1", "sha256": "ab" * 32, "mime_type": "application/x-dosexec", "tx_hosts": c2}, {"ts": BASE, "fuid": "F2", "sha256": "-"}])

    # beta: the same victim address with harmless traffic and a lease.
    lines(beta / "conn.log", [{"ts": BASE + i * 7 % 500, "uid": f"n{i}"} | ends(victim, c2, 443, orig_bytes=i * 100, conn_state="SF") for i in range(5)])
    lines(beta / "dns.log", [{"ts": BASE + i, "uid": f"q{i}", "query": "www.example.com", "qtype_name": "A", "rcode_name": "NOERROR"} | ends(victim, controller, 53) for i in range(3)])
    lines(beta / "dhcp.log", [{"ts": BASE, "assigned_addr": "10.0.0.77", "mac": "aa:bb", "host_name": "desk", "domain": "home.net"}])
    # gamma: a log without rows.
    (logs / "gamma").mkdir()
    (logs / "gamma" / "weird.log").write_text(json.dumps({"ts": 1.0, "name": "odd"}) + "\n")

    def packet(n, protocols, src, dst, length=100, **more):
        row = {"frame.number": n, "frame.time_epoch": BASE + n, "frame.len": length, "frame.protocols": f"eth:ip:{protocols}", "eth.src": f"mac-{src}", "ip.src": src, "ip.dst": dst, "ip.ttl": 128} | more
        return "\t".join(str(row.get(f, "")) for f in PACKET_FIELDS)

    head = "\t".join(PACKET_FIELDS)
    rows = [packet(i, "udp:dns", victim, controller, **{"udp.dstport": 53}) for i in range(1, 61)]
    rows += [packet(100 + i, "tcp:tls", victim, c2, 1000, **{"tcp.dstport": 443}) for i in range(60)]
    rows += [packet(200 + i, "tcp:http", victim, c2, **{"tcp.dstport": 8000, "http.authorization": "Basic x" if i == 3 else ""}) for i in range(30)]
    rows += [packet(300 + i, "tcp:nbss:smb2", victim, controller, **{"tcp.dstport": 445}) for i in range(10)]
    rows += [packet(400, "tcp:dcerpc:drsuapi", victim, controller), packet(401, "tcp:dcerpc:drsuapi", controller, victim)]
    rows += [packet(500, "udp:dns", controller, victim, **{"dns.qry.name": "files.corp.example.com.", "dns.flags.response": "1", "dns.a": "10.0.0.10"})]
    for name, text in (("alpha", rows), ("beta", [packet(1, "udp:dns", victim, controller)])):
        (root / "packets" / name).mkdir(parents=True)
        (root / "packets" / name / "packets.tsv").write_text("\n".join([head, *text]) + "\n")
    alerts = [{"event_type": "alert", "timestamp": "2023-11-14T22:13:20", "src_ip": victim, "dest_ip": c2, "alert": {"signature": "ET MALWARE Win32/Lumma Stealer Related Domain (whitepepper.su)", "severity": 1}}] * 3
    lines(root / "alerts" / "alpha" / "eve.json", alerts)
    lines(root / "rep" / "a.json", [{"data": {"id": c2, "attributes": {"last_analysis_stats": {"malicious": 9}}}}])
    lines(root / "feed" / "a.json", [{"search_term": "198.51.100.9", "data": "no_result"}])
    inputs = read_inputs(
        spark, str(logs), packets=str(root / "packets"), alerts=str(root / "alerts"),
        ip_reputation=str(root / "rep"), ioc_feed=str(root / "feed"),
    )
    return analyze(spark, inputs, Options())


def by_capture(table):
    out = {}
    for row in table.collect():
        out.setdefault(row.capture_id, []).append(row)
    return out


def test_signals_of_each_capture(results):
    got = {k: v[0] for k, v in by_capture(results["signals"]).items()}
    assert set(got) == {"alpha", "beta", "gamma"}
    a, b, g = got["alpha"], got["beta"], got["gamma"]
    assert (a.scan_candidate_count, a.scan_max_unique_dst_ports, a.scan_max_unique_dst_hosts) == (1, 203, 43)
    assert (a.scan_syn_only_connection_count, a.winrm_connection_count, a.inbound_scan_unique_src_count) == (206, 1, 1)
    assert (a.max_outbound_bytes, a.http_plaintext_post_count, a.http_base64_uri_count) == (50_000_000, 60, 60)
    assert (a.tls_missing_sni_count, a.tls_cert_anomaly_count, a.tls_unique_ja3_count) == (6, 1, 1)
    assert (a.smb_admin_share_detected, a.smb_lateral_host_count, a.kerberos_rc4_tgs_count) == (True, 3, 3)
    assert (a.dns_suspicious_parent_count, a.dns_singleton_suspicious_count, a.dns_base64_label_count) == (1, 1, 12)
    assert (a.drsuapi_packet_count, a.drsuapi_attacker_source_count) == (2, 1)
    assert (a.http_on_nonstandard_port_count, a.http_cleartext_creds_detected) == (30, True)
    assert a.beacon_top_score > 0.5
    assert (b.scan_candidate_count, b.max_outbound_bytes, b.smb_lateral_host_count, b.beacon_top_score) == (0, 0, 0, 0.0)
    assert (b.dns_packet_count, b.dns_unique_query_count) == (1, 1)
    assert all(v in (0, 0.0, False) for k, v in g.asDict().items() if k != "capture_id")


def test_findings_stay_in_their_capture(results):
    rows = by_capture(results["findings"])
    found = {r.ttp_id: r for r in rows["alpha"]}
    assert {"T1046", "T1071.004", "T1021.002", "T1071", "T1573.001", "T1048.003"} <= set(found)
    assert found["T1071"].confidence == "HIGH" and found["T1071"].score == 1.0
    assert "sigma_rule_confirmed" in found["T1021.002"].signals_fired
    assert "T1046" not in {r.ttp_id for r in rows.get("beta", [])}


def test_evidence(results):
    scan = results["evidence_scan"].collect()
    assert [(r.capture_id, r.scanner_ip, r.unique_dst_hosts_count, len(r.unique_dst_ports)) for r in scan] == [("alpha", "10.0.0.5", 43, 50)]
    assert {r.event for r in results["evidence_scan_timeline"].collect()} == {"scan_start", "scan_end", "duration_secs"}
    assert results["evidence_smb_shares"].count() == 3 and results["evidence_smb_files"].count() == 1
    assert results["evidence_dns"].count() == 12
    assert results["evidence_transfers"].first().uid == "big" and results["evidence_posts"].count() == 20
    assert {r.ttp_id for r in results["evidence_summaries"].collect()} >= {"T1046", "T1021.002", "T1071.004", "T1048.003"}


def test_indicators(results):
    ips = {(r.capture_id, r.ip): r.reasons for r in results["ioc_ips"].collect()}
    assert set(ips[("alpha", "203.0.113.7")]) == {"alert_destination", "certificate_anomaly", "confirmed_malicious", "post_destination", "top_talker"}
    assert ips[("alpha", "198.51.100.9")] == ["large_transfer"]
    assert not any(ip.startswith("10.") for _, ip in ips)
    assert {(r.capture_id, r.domain) for r in results["ioc_domains"].collect()} == {("alpha", "tunnel.com"), ("alpha", "whitepepper.su")}
    assert [r.sha256 for r in results["ioc_hashes"].collect()] == ["ab" * 32]
    assert [(r.ip, r.is_confirmed_malicious) for r in results["ioc_enrichment"].collect()] == [("203.0.113.7", True)]
    assert [r.ja3_family for r in results["ja3_matches"].collect()] == ["Cobalt Strike default beacon"]


def test_victims(results):
    got = {r.capture_id: r for r in results["victims"].collect()}
    a, b = got["alpha"], got["beta"]
    assert (a.ip, a.windows_user, a.domain, a.hostname, a.mac) == ("10.0.0.5", "alice", "corp.example.com", "desk-five", "mac-10.0.0.5")
    assert (b.ip, b.windows_user, b.domain, b.hostname, b.mac) == ("10.0.0.77", None, "home.net", "desk", "aa:bb")


def test_report_tables(results):
    summary = {r.capture_id: r for r in results["summary"].collect()}["alpha"]
    assert summary.malware_family == "Win32/Lu"  # the pattern takes as little as it can
    assert summary.confirmed_ips == ["203.0.113.7"] and summary.severity == "high" and "alice" in summary.victim
    certs = results["certificates"].first()
    assert set(certs.anomalies) == {"self-signed", "expired_at_capture_time", "generic_cn_looks_generated"}
    assert [r.path for r in results["smb_writes"].collect()] == [r"DC1\C$\tool.exe"]
    view = results["finding_view"].where("ttp_id = 'T1046'").first()
    assert view.evidence_summary.startswith("10.0.0.5 contacted 43 hosts") and view.guidance
    assert {r.hostname for r in results["hostnames"].collect()} == {"files.corp.example.com"}
    assert results["alert_duplicates"].first().alert_count == 3
    assert results["captures"].where("capture_id = 'alpha'").first().total_flows == 2


def test_anomalies(results):
    kinds = {r.anomaly_type for r in results["anomalies"].where("capture_id = 'alpha'").collect()}
    assert {"tls_missing_sni", "singleton_suspicious_domains"} <= kinds
    assert results["anomalies"].where("capture_id = 'gamma'").count() == 0


def test_display_filters(results):
    rows = results["display_filters"].where("capture_id = 'alpha'").collect()
    texts = {r.filter for r in rows}
    assert "ip.addr == 10.0.0.5" in texts and "ip.src == 10.0.0.5 && ip.dst == 203.0.113.7" in texts
    assert 'dns.qry.name contains "tunnel.com"' in texts
    assert "ip.addr == 10.0.0.5 && ip.addr == 10.0.0.10 && (smb || smb2)" in texts
    assert not any("{" in t for t in texts)
    assert len({(r.section, r.ttp_id, r.at) for r in rows}) == len(rows)


def test_every_table_can_be_read(results):
    for name, table in results.items():
        assert table.limit(1).collect() is not None, name
