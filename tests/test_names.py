"""Name, address and text expressions, DNS signals and the anomaly checks."""

import ipaddress
import math
import random
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netquarry.functions import net, text
from netquarry.functions.lists import HIGH_RISK_TLDS, INTERNAL_RANGES, NAME_KEYWORDS
from netquarry.operators import anomaly, inventory, signals as sig
from netquarry.sources.rules import Allowlist, load_allowlist, networks
from test_scoring import scored, signals


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def entropy(s):
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()) if s else 0.0


def plain_suspicion(name):
    """Risky ending, delivery keyword or random-looking stem; local, reverse and service names never."""
    if not name:
        return False
    name = name.lower().rstrip(".")
    labels = name.split(".")
    if len(labels) < 2 or name.endswith((".local", ".arpa")) or name.startswith("_") or "._" in name:
        return False
    stem = labels[-2]
    return (labels[-1] in HIGH_RISK_TLDS or bool(re.search("|".join(NAME_KEYWORDS), name.replace(".", "")))
            or (len(stem) >= 8 and entropy(stem) > 3.5))


def own_names():
    """Names made from every branch of the rule, plain and mixed."""
    rng = random.Random(12)
    plain, endings = ["alpha", "mapleroad", "paper", "bb", "x1"], ["com", "org", "local", "arpa", *list(HIGH_RISK_TLDS)[:6]]
    words = [w for w in NAME_KEYWORDS if w.isalnum()][:8]
    out = [None, "", ".", "single", "..", "UPPER.LOCAL."]
    for _ in range(300):
        stem = rng.choice([rng.choice(plain), rng.choice(plain) + rng.choice(words or plain),
                           "".join(rng.sample("bcdfghjklmnpqrstvwxz0123456789", rng.randint(6, 16)))])
        front = rng.choice(["", "", "www.", "_srv._tcp.", "a._b.", "deep.er."])
        name = front + stem + "." + rng.choice(endings)
        out.append(rng.choice([name, name, name.upper(), name + "."]))
    return out


def test_suspicious_names_by_the_rule(spark):
    names = own_names()
    want = [plain_suspicion(n) for n in names]
    assert apply(spark, text.is_suspicious_name, names) == want
    assert 40 < sum(want) < len(want) - 40


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abcXYZ019-._é$\\*+?", max_size=40), min_size=30, max_size=60))
def test_entropy_equals_its_definition(spark, values):
    got = apply(spark, text.shannon_entropy, values)
    assert got == pytest.approx([entropy(v) for v in values], abs=1e-9)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(
    st.ip_addresses(v=4).map(str), st.sampled_from(["10.0.0.1", "172.31.255.255", "172.32.0.0", "0.0.0.0", "0.0.0.1",
    "010.0.0.1", "10.0.0.256", "::1", "", "host", "169.254.9.9", "192.168.1"])), min_size=40, max_size=80))
def test_internal_equals_ipaddress(spark, values):
    nets = [ipaddress.ip_network(c) for c in INTERNAL_RANGES]

    def parse(v):
        try:
            return ipaddress.ip_address(v)
        except ValueError:
            return None

    parsed = [parse(v) for v in values]
    assert apply(spark, net.is_internal, values) == [p is not None and any(p in n for n in nets) for p in parsed]
    assert apply(spark, net.ip_to_long, values) == [int(p) if p is not None and p.version == 4 else None for p in parsed]


def test_networks_of_many_lengths(spark):
    cidrs = ["10.0.0.0/8", "203.0.113.64/26", "1.2.3.4/32", "0.0.0.0/1", "bad", "192.0.2.0/24"]
    ips = ["10.9.9.9", "203.0.113.70", "203.0.113.1", "1.2.3.4", "200.0.0.1", "192.0.2.200", "x", None]
    df = spark.createDataFrame([(ip,) for ip in ips], "ip string")
    nets = [ipaddress.ip_network(c) for c in cidrs if c != "bad"]
    want = {ip for ip in ips if ip not in ("x", None) and any(ipaddress.ip_address(ip) in n for n in nets)}
    assert {r.ip for r in inventory.cidr_semi_join(df, "ip", networks(spark, cidrs)).collect()} == want
    rest = {r.ip for r in inventory.cidr_semi_join(df, "ip", networks(spark, cidrs), "left_anti").collect()}
    assert rest == set(ips) - want


def test_allowlist(spark):
    allow = load_allowlist(spark)
    assert allow.rule_count == 8 + 12
    assert allow.protocols == ["dhcp", "llmnr", "mdns", "nbns", "ssdp"]
    ips = spark.createDataFrame([("104.20.1.1",), ("8.8.8.8",)], "ip string")
    assert {(r.ip, r.allowed) for r in inventory.mark_allowed(ips, allow).collect()} == {("104.20.1.1", True), ("8.8.8.8", False)}
    names = spark.createDataFrame([("WWW.Apple.com.",), ("pineapple.com",)], "domain string")
    assert {r.domain: r.allowed for r in inventory.mark_allowed(names, allow, "domain").collect()} == {
        "WWW.Apple.com.": True, "pineapple.com": False,
    }


def test_small_texts(spark):
    assert apply(spark, text.parse_bytes, ["570 kB", "1.2 MB", "12345", "x", "3 GB"]) == [570000, 1200000, 12345, 0, 3000000000]
    assert apply(spark, lambda c: text.format_bytes(c.cast("double")), ["12", "1234", "5000000", "7e9", "3e15"]) == [
        "12.0 B", "1.2 KB", "4.8 MB", "6.5 GB", "2728.5 TB",
    ]
    assert apply(spark, net.ttl_to_os, ["32", "64", "128", "200", "x", None]) == [
        "windows-old/printer", "linux/macos", "windows", "network-device", "unknown", "unknown",
    ]
    assert apply(spark, text.unc_domain, [r"\\DC1.corp.example.com\C$", r"\\SRV\share", "x", r"\\a.b\c"]) == [
        "corp.example.com", None, None, None,
    ]
    assert apply(spark, lambda c: text.smb_path(c, F.lit("f.exe")), [r"\\SRV\C$", None, "\\"]) == [
        r"SRV\C$\f.exe", "f.exe", "f.exe",
    ]
    assert apply(spark, text.signature_to_technique, ["et scan NMAP x", "ET SCAN other", "ET DNS Query to a *.tk domain", "none"]) == [
        "T1046", "T1046", "T1568.002", None,
    ]
    assert apply(spark, text.domains_in_text, ["Domain (Bad-Host .SU) and (x.y) (ok.example.com)"]) == [
        ["bad-host.su", "ok.example.com"],
    ]
    assert apply(spark, text.family_from_text, [
        "ET MALWARE Win32/Lumma Stealer Related", "ET MALWARE NetSupport RAT CnC", "ET INFO x",
    ])[1:] == ["NetSupport RAT", None]
    assert apply(spark, text.principal_realm, ["bob/CORP.EXAMPLE", "bob"]) == ["corp.example", None]


def dns(spark, names, capture="c"):
    rows = [(capture, float(i), f"u{i}", "10.0.0.1", q, "A", "NOERROR") for i, q in enumerate(names)]
    return spark.createDataFrame(
        rows, "capture_id string, ts double, uid string, orig_h string, query string, qtype_name string, rcode_name string"
    )


@pytest.mark.parametrize("names, found", [
    (["google.com", "google.com", "netsupportsoftware.com"], ["netsupportsoftware.com"]),
    (["whooptm.cyou", "whooptm.cyou"], []),
    (["maps.google.com"], []),
    (["whitepepper.su", "qxzjvwfbkpmn.net", "modandcrackedapk.com", "microsoft.com", "microsoft.com"],
     ["modandcrackedapk.com", "qxzjvwfbkpmn.net", "whitepepper.su"]),
    (["loader.su", "safe.com", "safe.com"], ["loader.su"]),
])
def test_singletons(spark, names, found):
    table = dns(spark, names)
    assert sorted(r.query for r in sig.dns_singletons(table).collect()) == found
    assert sig.dns_signals(table).first().dns_singleton_suspicious_count == len(found)


def test_encoded_labels(spark):
    label = "QWxhZGRpbjpPcGVuU2VzYW1lMTIzNDU2"
    names = [f"{label}.example.com", f"{label}.example.local", f"_x.{label}.com", "deadbeef" * 4 + ".example.com", f"{label}.{label}.com"]
    assert sig.dns_signals(dns(spark, names)).first().dns_base64_label_count == 2


def test_suspicious_parent_needs_many_long_labels(spark):
    long = [f"{'a' * 16}{i}.tunnel.com" for i in range(11)]
    short = [f"h{i}.cdn.com" for i in range(30)]
    srv = [f"_s{i}.{'b' * 20}.srv.com" for i in range(20)]
    assert sig.dns_signals(dns(spark, long + short + srv)).first().dns_suspicious_parent_count == 1
    assert sig.dns_signals(dns(spark, long[:10])).first().dns_suspicious_parent_count == 0


def test_dns_ratios_count_null_queries(spark):
    rows = [("c", 1.0, "u", "h", None, "TXT", "NXDOMAIN"), ("c", 2.0, "v", "h", "abcd", "A", None)]
    table = spark.createDataFrame(
        rows, "capture_id string, ts double, uid string, orig_h string, query string, qtype_name string, rcode_name string"
    )
    row = sig.dns_signals(table).first()
    assert (row.dns_unique_query_count, row.dns_avg_query_length) == (1, 4.0)
    assert (row.dns_txt_null_ratio, row.dns_nxdomain_rate) == (0.5, 0.5)


def find(spark, findings=(), singletons=(), **values):
    table = anomaly.anomalies(signals(spark, **values), scored(spark, *findings), singletons=dns(spark, singletons))
    return {r.anomaly_type: r for r in table.collect()}


def test_anomaly_of_single_names(spark):
    hit = find(spark, singletons=["whooptm.cyou"], dns_singleton_suspicious_count=1)["singleton_suspicious_domains"]
    assert "whooptm.cyou" in hit.description and "whooptm.cyou" in hit.raw_signals
    assert hit.anomaly_id == "ANO-0001" and hit.prompt
    assert find(spark) == {}


def test_anomalies_are_numbered_and_explained_away(spark):
    values = {"dns_nxdomain_rate": 0.25, "http_plaintext_post_count": 50, "scan_max_unique_dst_hosts": 20,
              "tls_missing_sni_count": 5, "arp_ip_conflict_count": 1, "dns_singleton_suspicious_count": 1}
    every = find(spark, **values)
    assert [r.anomaly_id for r in every.values()] == [f"ANO-000{i}" for i in range(1, 7)]
    strong = [("c", "T1071.004", 0.6, "HIGH"), ("c", "T1048.003", 0.59, "HIGH"), ("c", "T1046", 0.9, "HIGH")]
    fewer = find(spark, strong, **values)
    assert set(every) - set(fewer) == {"dns_nxdomain_pattern", "broad_host_contact"}
    assert fewer["high_http_post_volume"].anomaly_id == "ANO-0001"
    assert fewer["tls_missing_sni"].ttps_checked == ["T1046", "T1071.004", "T1048.003"]
