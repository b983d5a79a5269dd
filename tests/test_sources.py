"""Readers, on hand-made files."""

import gzip
import json

import pytest

from netquarry.operators import artifacts, ioc
from netquarry.schemas import PACKET_FIELDS
from netquarry.sources import alerts, intel, packets, rules, sinks, zeek


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return path


@pytest.fixture
def logs(tmp_path):
    lines = [
        "#fields junk", "",
        json.dumps({"ts": 1.5, "uid": "a", "id.orig_h": "10.0.0.1", "id.resp_h": "1.2.3.4", "id.resp_p": 443, "orig_bytes": 8.0}),
        '{"ts": 2.0, "uid": "broken',
        json.dumps({"ts": "2.5", "uid": "b", "id.orig_h": "10.0.0.1", "id.resp_h": "1.2.3.4", "id.resp_p": "80", "orig_bytes": "x"}),
        json.dumps({"ts": 3, "uid": "c", "conn_state": "S0", "unknown_field": [1, 2]}),
    ]
    write(tmp_path / "alpha" / "conn.log", "\n".join(lines))
    write(tmp_path / "beta" / "conn.log", json.dumps({"ts": 9.0, "id.orig_h": "10.0.0.1"}))
    chains = [["f1", "f2"], '["f3"]', "f4", None]
    write(tmp_path / "beta" / "ssl.log", "\n".join(json.dumps({"ts": float(i), "cert_chain_fps": c}) for i, c in enumerate(chains)))
    write(tmp_path / "gamma" / "smb_files.log", "")
    write(tmp_path / "beta" / "files.log", json.dumps({"sha256": "abc", "filename": "A.exe"}))
    return str(tmp_path)


def test_log_lines_with_odd_types_are_kept(spark, logs):
    rows = {r.uid: r for r in zeek.read_zeek(spark, logs, "conn").where("capture_id = 'alpha'").collect()}
    assert set(rows) == {"a", "b", "c"}
    assert (rows["a"].ts, rows["a"].resp_p, rows["a"].orig_bytes) == (1.5, 443, 8)
    assert (rows["b"].ts, rows["b"].resp_p, rows["b"].orig_bytes) == (2.5, 80, None)
    assert (rows["c"].ts, rows["c"].orig_h, rows["c"].conn_state) == (3.0, None, "S0")


def test_captures_are_directories(spark, logs):
    assert {r.capture_id for r in zeek.read_zeek(spark, logs, "conn").collect()} == {"alpha", "beta"}
    assert zeek.read_zeek(spark, f"{logs}/beta", "conn").first().capture_id == "beta"


def test_rotated_and_compressed_files_belong_to_their_log(spark, tmp_path):
    names = {
        "conn.log": 1, "conn.log.gz": 2, "conn.10_00_00-11_00_00.log": 3, "conn.2024-05-01-10-00-00.log.gz": 4,
        "conn-summary.log": 5, "connection.log": 6, "conn.note.txt": 7,
    }
    (tmp_path / "alpha").mkdir()
    for name, ts in names.items():
        line = (json.dumps({"ts": ts, "uid": "u"}) + "\n").encode()
        (tmp_path / "alpha" / name).write_bytes(gzip.compress(line) if name.endswith(".gz") else line)
    got = zeek.read_zeek(spark, str(tmp_path), "conn")
    assert sorted((r.capture_id, r.ts) for r in got.collect()) == [("alpha", float(n)) for n in range(1, 5)]


def test_absent_log_or_path_is_empty(spark, logs):
    assert zeek.read_zeek(spark, logs, "dns").count() == 0
    assert zeek.read_zeek(spark, f"{logs}/nowhere", "conn").count() == 0
    assert zeek.read_zeek(spark, logs, "files").count() == 1  # smb_files.log is another log
    assert zeek.available_logs(spark, f"{logs}/nowhere").count() == 0


def test_fingerprint_lists_in_three_forms(spark, logs):
    rows = zeek.read_zeek(spark, logs, "ssl").orderBy("ts").collect()
    assert [r.cert_chain_fps for r in rows] == [["f1", "f2"], ["f3"], ["f4"], None]


def test_available_logs(spark, logs):
    got = {r.capture_id: r.logs for r in zeek.available_logs(spark, logs).collect()}
    assert got == {"alpha": ["conn.log"], "beta": ["conn.log", "files.log", "ssl.log"]}  # Spark lists no empty files


def test_raw_log_takes_extra_fields(spark, logs):
    row = zeek.read_zeek_raw(spark, logs, "conn", ["unknown_field"]).where("uid = 'c'").first()
    assert row.unknown_field == "[1, 2]" and row.ts == "3"


def packet_line(**fields):
    return "\t".join(str(fields.get(name, "")) for name in PACKET_FIELDS)


def test_packets(spark, tmp_path):
    text = "\n".join([
        "\t".join(PACKET_FIELDS),
        packet_line(**{"frame.number": 1, "frame.time_epoch": 1.25, "frame.len": 60, "frame.protocols": "eth:ethertype:ip:tcp:HTTP",
                       "ip.src": "10.0.0.1", "ip.dst": "1.2.3.4", "tcp.dstport": 80, "http.authorization": 'Basic "x'}),
        packet_line(**{"frame.number": 2, "frame.time_epoch": 2, "frame.len": 90, "dns.a": "1.1.1.1, 2.2.2.2", "dns.flags.response": "True"}),
    ])
    write(tmp_path / "alpha" / "packets.tsv", text)
    rows = packets.read_packets(spark, str(tmp_path)).orderBy("frame_no").collect()
    assert rows[0].protocols == ["eth", "ethertype", "ip", "tcp", "http"]
    assert (rows[0].capture_id, rows[0].ts, rows[0].tcp_dstport, rows[0].http_authorization) == ("alpha", 1.25, 80, 'Basic "x')
    assert rows[1].dns_a == ["1.1.1.1", "2.2.2.2"] and rows[1].dns_is_response and rows[1].ip_src is None
    assert packets.read_packets(spark, str(tmp_path / "none")).count() == 0
    target = str(tmp_path / "parquet")
    packets.read_packets(spark, str(tmp_path)).write.parquet(target)
    assert packets.read_packets(spark, target, format="parquet").count() == 2


def test_alerts(spark, tmp_path):
    events = [
        {"event_type": "flow"},
        {"event_type": "alert", "src_ip": "10.0.0.1", "dest_ip": "1.2.3.4", "dest_port": 443, "alert": {"signature": "ET SCAN NMAP", "severity": 1}},
        {"event_type": "alert"},
    ]
    write(tmp_path / "alpha" / "eve.json", "\n".join(map(json.dumps, events)) + "\nnot json\n")
    rows = alerts.read_alerts(spark, str(tmp_path)).orderBy("severity").collect()
    assert [(r.severity, r.technique, r.dst_port) for r in rows] == [(1, "T1046", 443), (3, None, 0)]
    assert alerts.read_alerts(spark, str(tmp_path / "none")).count() == 0


def test_beacon_csv_files_have_their_own_header(spark, tmp_path):
    for capture, lines in {
        "a": ["Score,Source IP,Destination IP,Connections", '0.9,10.0.0.1,"1.2.3.4",12', "bad,10.0.0.1,1.2.3.4,1"],
        "b": ["Connections,Destination IP,Score,Other,Source IP", "7,5.6.7.8,0.4,x,10.0.0.2", "8,5.6.7.9,0.5,,10.0.0.2"],
        "c": ["No results"],
    }.items():
        (tmp_path / capture).mkdir()
        (tmp_path / capture / "beacons.csv").write_text("\n".join(lines) + "\n")
    rows = {(r.capture_id, r.dst_ip): r for r in alerts.read_beacon_csv(spark, str(tmp_path)).collect()}
    assert set(rows) == {("a", "1.2.3.4"), ("b", "5.6.7.8"), ("b", "5.6.7.9")}
    first, second = rows["a", "1.2.3.4"], rows["b", "5.6.7.8"]
    assert (first.score, first.src_ip, first.connections, first.avg_bytes) == (0.9, "10.0.0.1", 12, 0.0)
    assert (second.score, second.src_ip, second.connections, second.size_skew) == (0.4, "10.0.0.2", 7, 0.0)


def test_beacon_csv(spark, tmp_path):
    header = "Score,Source IP,Destination IP,Connections,Avg. Bytes,Intvl Range,Size Range,Top Intvl,Top Size,Intvl Skew,Size Skew"
    text = f"{header}\n0.9, 10.0.0.1 ,1.2.3.4,100,50.5,1,1,60,1,0.1,0.2\nbad,10.0.0.2,1.2.3.4,1,1,1,1,1,1,1,1\n"
    write(tmp_path / "alpha" / "beacons.csv", text)
    rows = alerts.read_beacon_csv(spark, str(tmp_path)).collect()
    assert [(r.capture_id, r.score, r.src_ip, r.connections, r.top_interval_secs) for r in rows] == [("alpha", 0.9, "10.0.0.1", 100, 60.0)]
    empty = write(tmp_path / "other" / "beacons.csv", "No results were found\n")
    assert alerts.read_beacon_csv(spark, str(empty.parent)).count() == 0


def test_reputation(spark, tmp_path):
    stats = {"malicious": 4, "suspicious": 1, "harmless": 50, "undetected": 9}
    answers = [
        {"data": {"id": "1.2.3.4", "attributes": {"as_owner": "ACME", "country": "ZZ", "reputation": -5, "tags": ["x"], "last_analysis_stats": stats}}},
        {"data": {"id": "5.6.7.8", "attributes": {}}},
        {"error": "not found"},
    ]
    write(tmp_path / "ip" / "a.json", "\n".join(map(json.dumps, answers)))
    rows = {r.ip: r for r in intel.read_ip_reputation(spark, str(tmp_path / "ip")).collect()}
    assert set(rows) == {"1.2.3.4", "5.6.7.8"}
    assert (rows["1.2.3.4"].owner, rows["1.2.3.4"].malicious, rows["5.6.7.8"].malicious) == ("ACME", 4, 0)
    table = intel.read_ip_reputation(spark, str(tmp_path / "ip"))
    assert [r.ip for r in table.where(intel.is_malicious()).collect()] == ["1.2.3.4"]
    assert intel.read_domain_reputation(spark, str(tmp_path / "ip")).columns[:3] == ["domain", "registrar", "categories"]
    assert intel.read_hash_reputation(spark, str(tmp_path / "none")).count() == 0


def test_feed_and_verdict(spark, tmp_path):
    hit = {"ioc": "1.2.3.4:443", "threat_type": "botnet_cc", "malware_printable": "Lumma", "confidence_level": 75, "tags": ["C2"], "malware_samples": [{"a": 1}]}
    answers = [
        {"search_term": "1.2.3.4", "query_status": "ok", "data": [hit, hit | {"confidence_level": 50, "malware_printable": None, "malware": "raw", "malware_samples": []}]},
        {"search_term": "5.6.7.8", "query_status": "no_result", "data": "Your search did not yield any results"},
    ]
    write(tmp_path / "feed.json", "\n".join(map(json.dumps, answers)))
    feed = intel.read_ioc_feed(spark, str(tmp_path))
    assert sorted((r.malware, r.confidence) for r in feed.collect()) == [("Lumma", 75), ("raw", 50)]
    best = ioc.best_feed_hit(feed).first()
    assert (best.malware, best.confidence, best.total_hits, best.has_samples) == ("Lumma", 75, 2, True)
    assert intel.feed_by_hash(feed, "1.2.3.4:443").count() == 2 and intel.feed_by_tag(feed, "C2").count() == 2
    targets = spark.createDataFrame([("c", "1.2.3.4"), ("c", "5.6.7.8")], "capture_id string, ip string")
    reputation = spark.createDataFrame(
        [("5.6.7.8", "o", "ZZ", 2, 0, 0)], "ip string, owner string, country string, malicious bigint, suspicious bigint, reputation bigint"
    )
    got = {r.ip: r.is_confirmed_malicious for r in ioc.enrich(targets, reputation, feed).collect()}
    assert got == {"1.2.3.4": True, "5.6.7.8": False}


def test_playbook_directory(spark, tmp_path):
    write(tmp_path / "b" / "two.yaml", "ttp_id: T2\nsignals: []\n---\nttp_id: T3\n")
    write(tmp_path / "a.yaml", "ttp_id: T1\nminimum_presence: {dns_packet_count: 5}\nsignals:\n  - {id: s, source: dns_packet_count, threshold: '>= 5', weight: 0.5}\n")
    write(tmp_path / "none.yaml", "name: no id\n")
    write(tmp_path / "broken.yaml", "ttp_id: [\n")
    with pytest.warns(UserWarning, match="broken.yaml"):
        loaded = rules.load_playbooks(spark, str(tmp_path))
    assert sorted(r.ttp_id for r in loaded.rules.collect()) == ["T1", "T2", "T3"]
    assert loaded.gates.count() == 1 and loaded.signals.first().op == ">=" and loaded.bonuses.count() == 0


def test_allowlist_file(spark, tmp_path):
    write(tmp_path / "own.yaml", "ntp_servers: [10.0.0.0/8, nonsense]\nupdate_servers: {domains: [Example.COM]}\nlocal_protocols_to_clear: [MDNS]\n")
    allow = rules.load_allowlist(spark, str(tmp_path))
    assert allow.nets.count() == 1 and allow.domains.first().domain == "example.com"
    assert (allow.protocols, allow.rule_count) == (["mdns"], 2)


def test_findings_sink(spark, tmp_path):
    findings = spark.createDataFrame([("c", "T1", {"a": 1.0})], "capture_id string, ttp_id string, raw_values map<string,double>")
    anomalies = spark.createDataFrame([("c", "ANO-0001")], "capture_id string, anomaly_id string")
    paths = sinks.write_findings(findings, anomalies, str(tmp_path / "out"))
    assert spark.read.json(paths["findings"]).first().ttp_id == "T1"
    assert spark.read.json(paths["anomalies"]).first().capture_id == "c"


def test_file_hashes(spark, tmp_path):
    import hashlib

    for name in ("A.exe", "b.txt"):
        write(tmp_path / "alpha" / "http" / name, "same content")
    log = spark.createDataFrame(
        [("alpha", 1.0, "f1", "a.EXE", "old"), ("alpha", 2.0, "f2", "a.exe", "application/x-dosexec")],
        "capture_id string, ts double, fuid string, filename string, mime_type string",
    )
    files = artifacts.file_hashes(spark, str(tmp_path), log)
    got = {r.filename: (r.capture_id, r.protocol, r.sha256, r.size_bytes, r.mime_type) for r in files.collect()}
    digest = hashlib.sha256(b"same content").hexdigest()
    assert got["A.exe"] == ("alpha", "HTTP", digest, 12, "application/x-dosexec")
    assert got["b.txt"][-1] == "application/octet-stream"
    group = artifacts.duplicate_files(files).first()
    assert (group.file_count, group.filename) == (2, "A.exe")
    assert artifacts.file_hashes(spark, str(tmp_path / "none")).count() == 0
