"""Packets are read three times whatever is asked of them; reductions answer as the rows do."""

import random

import pytest
from pyspark.sql import functions as F

from netquarry.functions.text import shannon_entropy
from netquarry.operators import alerts as alert_ops
from netquarry.operators import artifacts, evidence, inventory, ioc, packets as packet_ops, signals as sig
from netquarry.plans.analyze import Inputs, Options, analyze
from netquarry.schemas import ALERT_SCHEMA, PACKET_SCHEMA


def packet_rows(n, seed=5):
    rng = random.Random(seed)
    names = [c.split()[0] for c in PACKET_SCHEMA.split(", ")]
    rows = []
    for i in range(n):
        row = dict.fromkeys(names) | {
            "capture_id": rng.choice("ab"), "frame_no": i, "ts": 100.0 + i / 8, "frame_len": rng.randint(60, 1500),
            "protocols": rng.choice([None, ["eth", "ip", "http"], ["eth", "ip", "dns"], ["eth", "arp"], ["eth", "ip", "icmp"], ["ip", "drsuapi"]]),
            "eth_src": rng.choice([None, "", "m1", "m2"]), "ip_src": rng.choice([None, "", "10.0.0.1", "10.0.0.2,8.8.8.8", "8.8.4.4"]),
            "ip_dst": rng.choice(["10.0.0.9", "9.9.9.9", None]), "ip_ttl": rng.choice([None, "64", "128"]),
            "tcp_dstport": rng.choice([None, 80, 8000]), "udp_dstport": rng.choice([None, 53, 99]),
            "arp_opcode": rng.choice([None, 1, 2]), "arp_src_ip": rng.choice([None, "", "1.1.1.1", "1.1.1.2"]),
            "arp_dst_ip": rng.choice([None, "1.1.1.1"]), "arp_src_mac": rng.choice([None, "", "x", "y"]),
            "data_len": rng.choice([None, 10, 900]), "http_authorization": rng.choice([None, "", "Basic"]),
            "ftp_command": rng.choice([None, "USER", "LIST"]), "dns_is_response": rng.choice([None, True, False]),
            "dns_qry_name": rng.choice([None, "", "a.b.", "c.d"]), "dns_a": rng.choice([None, [], ["5.5.5.5", ""], ["6.6.6.6"]]),
        }
        rows.append(tuple(row[c] for c in names))
    return rows


@pytest.fixture(scope="module")
def packets(spark):
    kinds = dict(c.split(" ", 1) for c in PACKET_SCHEMA.split(", "))
    typed = spark.createDataFrame(packet_rows(600), PACKET_SCHEMA.replace("ip_ttl " + kinds["ip_ttl"], "ip_ttl string"))
    return typed.withColumn("ip_ttl", F.col("ip_ttl").cast(kinds["ip_ttl"])).persist()


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_reductions_answer_as_the_packets_do(packets):
    rolled, facts, samples = packet_ops.packet_rollup(packets), packet_ops.packet_facts(packets), packet_ops.packet_samples(packets)
    for fn in (sig.packet_signals, sig.cleartext_signals, inventory.conversations, inventory.captures, inventory.protocol_histogram):
        assert rows(fn(packets)) == rows(fn(rolled)), fn
    for fn in (inventory.mac_ip, inventory.hostnames, inventory.os_hints, sig.arp_conflicts):
        assert rows(fn(packets)) == rows(fn(facts)) != [], fn
    for fn in (inventory.odd_ports, evidence.credential_evidence):
        assert rows(fn(packets)) == rows(fn(samples)) != [], fn


def test_facts_against_plain_loops(packets):
    raw = [r.asDict() for r in packets.collect()]
    first = lambda v: next((x.strip() for x in (v or "").split(",")[:1] if x.strip()), None)
    macs, systems, claims, names = {}, {}, {}, {}
    for r in raw:
        ip, c = first(r["ip_src"]), r["capture_id"]
        if r["eth_src"] and ip:
            macs.setdefault((c, r["eth_src"], ip), r["frame_no"])
        if ip and r["ip_ttl"] is not None:
            systems.setdefault((c, ip), int(r["ip_ttl"]))
        if r["arp_src_ip"] and r["arp_src_mac"]:
            claims.setdefault((c, r["arp_src_ip"]), set()).add(r["arp_src_mac"])
        if r["dns_is_response"] and r["dns_qry_name"]:
            for a in r["dns_a"] or []:
                if a:
                    names.setdefault((c, a), r["dns_qry_name"].rstrip("."))
    assert {(r.capture_id, r.mac, r.ip): r.first_frame for r in inventory.mac_ip(packets).collect()} == macs
    os_of = {64: "linux/macos", 128: "windows"}
    assert {(r.capture_id, r.ip): r.os_hint for r in inventory.os_hints(packets).collect()} == {k: os_of[v] for k, v in systems.items()}
    assert {(r.capture_id, r.ip): r.mac_count for r in sig.arp_conflicts(packets).collect()} == {k: len(v) for k, v in claims.items() if len(v) > 1}
    assert {(r.capture_id, r.ip): r.hostname for r in inventory.hostnames(packets).collect()} == names


def test_an_analysis_reads_the_packets_three_times(spark, packets):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    counted = packets.coalesce(1).mapInArrow(count, packets.schema)
    out = analyze(spark, Inputs(packets=counted, logs={}), Options(offline=True, skip_anomalies=True))
    for name in ("protocols", "conversations", "top_talkers", "hosts", "mac_ip", "hostnames", "os_hints", "odd_ports", "captures", "signals"):
        out[name].collect()
    assert seen.value <= 3 * packets.count()
    assert rows(out["top_talkers"].drop("position")) == rows(out["conversations"])


def test_empty_packets(spark):
    none = spark.createDataFrame([], PACKET_SCHEMA)
    facts, samples = packet_ops.packet_facts(none), packet_ops.packet_samples(none)
    assert not any(fn(facts).collect() for fn in (inventory.mac_ip, inventory.hostnames, inventory.os_hints, sig.arp_conflicts))
    assert not inventory.odd_ports(samples).collect() and not sig.packet_signals(packet_ops.packet_rollup(none)).collect()


@pytest.mark.parametrize("seed", range(3))
def test_dns_evidence_against_all_lookups(spark, seed):
    rng = random.Random(seed)
    labels = ["abcdefgh", "hgfedcba", "aabbccdd", "qwertyuiop", "aaaa", "zxcvbnmasdf"]
    data = [
        (rng.choice("ab"), rng.choice([None, *[float(t) for t in range(5)]]), f"u{i:03d}", "h", rng.choice([*[f"{x}.com" for x in labels], None, "plain"]), "A", "OK")
        for i in range(200)
    ]
    dns = spark.createDataFrame(data, "capture_id string, ts double, uid string, orig_h string, query string, qtype_name string, rcode_name string")
    entropy = {x: spark.range(1).select(shannon_entropy(F.lit(x))).first()[0] for x in labels}
    for k in (1, 3, 40):
        want = []
        for c in "ab":
            of = [(-round(entropy[r[4].split(".")[0]], 9), r[1] is not None, r[1] or 0, r[2]) for r in data if r[0] == c and r[4] and "." in r[4]]
            want += [(c, i + 1, r[3]) for i, r in enumerate(sorted(r for r in of if -r[0] > 1.0)[:k])]
        got = evidence.dns_evidence(dns, k, 1.0)
        assert sorted((r.capture_id, r.position, r.uid) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("seed", range(2))
def test_first_and_worst_rows_against_plain_groups(spark, seed):
    rng = random.Random(seed)
    low = lambda v: (v is not None, v if v is not None else 0)
    names = [c.split()[0] for c in ALERT_SCHEMA.split(", ")]
    data = [
        dict.fromkeys(names) | {
            "capture_id": rng.choice("ab"), "timestamp": rng.choice(["t1", "t2", "t3"]), "src_ip": rng.choice([None, "x", "y", "z"]),
            "src_port": rng.randint(1, 9), "dst_ip": rng.choice(["d", None]), "dst_port": rng.randint(1, 9),
            "signature": rng.choice("pqr"), "severity": rng.choice([None, 1, 2, 3]), "technique": rng.choice("TU"), "category": "c",
        }
        for _ in range(300)
    ]
    alerts = spark.createDataFrame([tuple(r[n] for n in names) for r in data], ALERT_SCHEMA)
    got = {(r.capture_id, r.src_ip, r.dst_ip, r.signature): r for r in alert_ops.duplicate_alerts(alerts, 6).collect()}
    assert len(got) == 12
    for key, r in got.items():
        group = [a for a in data if (a["capture_id"], a["src_ip"], a["dst_ip"], a["signature"]) == key]
        worst = min(group, key=lambda a: (low(a["severity"]), a["timestamp"], a["src_port"], a["dst_port"], a["technique"]))
        known = [a["severity"] for a in group if a["severity"] is not None]
        assert (r.alert_count, r.severity) == (len(group), min(known, default=None))
        assert (r.src_port, r.dst_port, r.technique) == (worst["src_port"], worst["dst_port"], worst["technique"])
    files = [(rng.choice("ab"), rng.choice([None, "s1", "s2", "s3"]), rng.choice("fgh"), "m", rng.randint(1, 9)) for _ in range(60)]
    table = spark.createDataFrame(files, "capture_id string, sha256 string, filename string, mime_type string, size_bytes long")
    for r in artifacts.duplicate_files(table, 3).collect():
        group = [f for f in files if f[:2] == (r.capture_id, r.sha256)]
        assert (r.file_count, (r.filename, r.mime_type, r.size_bytes)) == (len(group), min(f[2:] for f in group))
    hits = [(rng.choice(["t", "u", None]), rng.choice([None, 50, 75, 90]), f"i{i}", "k", "m", rng.choice([None, "2020", "2021"]), [], rng.random() < 0.1) for i in range(40)]
    feed = spark.createDataFrame(hits, "term string, confidence int, ioc string, threat_type string, malware string, first_seen string, tags array<string>, has_samples boolean")
    best = {r.term: r for r in ioc.best_feed_hit(feed).collect()}
    assert set(best) == {h[0] for h in hits}
    for term, r in best.items():
        group = [h for h in hits if h[0] == term]
        top = max(group, key=lambda h: (low(h[1]), (h[5] is not None, h[5] or ""), h[2]))
        assert (r.ioc, r.confidence, r.total_hits, r.has_samples) == (top[2], top[1], len(group), any(h[7] for h in group))
