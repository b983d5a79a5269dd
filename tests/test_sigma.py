"""Log rules: modifiers, condition forms, samples, unsupported forms."""

import pytest

from netquarry.operators import sigma
from netquarry.sources.rules import load_sigma, parse_tags, sigma_rule

ROWS = [
    ("c", "1.0", "10.0.0.1", "8.8.8.8", "evil.example.com", "TXT"),
    ("c", "2.0", "10.0.0.2", "8.8.8.8", "GOOD.example.org", "A"),
    ("c", "3.0", "10.0.0.1", "9.9.9.9", None, "A"),
    ("d", "4.0", "10.0.0.3", None, "a+b.com", "A"),
]
SCHEMA = "capture_id string, ts string, orig_h string, resp_h string, query string, qtype_name string"


def hits(spark, detection):
    rule = sigma_rule({"title": "t", "id": "i", "logsource": {"service": "dns"}, "detection": detection})
    log = spark.createDataFrame(ROWS, SCHEMA)
    test = sigma.compile_rule(rule, [c for c in log.columns if c != "capture_id"])
    return None if test is None else sorted(r.ts for r in log.where(test).collect())


@pytest.mark.parametrize("item, found", [
    ({"query|contains": "EXAMPLE"}, ["1.0", "2.0"]),
    ({"query|contains": "*a+b*"}, ["4.0"]),
    ({"query|startswith": "good"}, []),
    ({"query|startswith": "GOOD*"}, ["2.0"]),
    ({"query|endswith": ["*.com", ".net"]}, ["1.0", "4.0"]),
    ({"query|re": "^GOOD.*org$"}, ["2.0"]),
    ({"query|re": "good"}, ["2.0"]),
    ({"query|re": "("}, []),
    ({"query": "evil.example.com"}, ["1.0"]),
    ({"query": "Evil.example.com"}, []),
    ({"query|contains|all": ["evil", "com"]}, ["1.0"]),
    ({"query": None}, []),
    ({"query": ""}, []),
    ({"QUERY": "evil.example.com"}, ["1.0"]),
    ({"id.orig_h": "10.0.0.1"}, ["1.0", "3.0"]),
    ({"missing": "x"}, []),
    ({"qtype_name": "A", "orig_h": "10.0.0.1"}, ["3.0"]),
    ({}, ["1.0", "2.0", "3.0", "4.0"]),
])
def test_items(spark, item, found):
    assert hits(spark, {"selection": item, "condition": "selection"}) == found


A, B = {"qtype_name": "A"}, {"orig_h": "10.0.0.1"}


@pytest.mark.parametrize("condition, found", [
    ("a1 and b1", ["3.0"]),
    ("a1 or b1", ["1.0", "2.0", "3.0", "4.0"]),
    ("a1 and not b1", ["2.0", "4.0"]),
    ("a1 and not nothing", ["2.0", "3.0", "4.0"]),
    ("all of them", ["3.0"]),
    ("1 of a*", ["2.0", "3.0", "4.0"]),
    ("1 of z*", None),
    ("b1", ["1.0", "3.0"]),
    (["b1", "a1"], ["1.0", "3.0"]),
])
def test_conditions(spark, condition, found):
    assert hits(spark, {"a1": A, "b1": B, "condition": condition}) == found


def test_unknown_condition_reads_as_first_group(spark):
    with pytest.warns(UserWarning, match="first group"):
        assert hits(spark, {"a1": A, "b1": B, "condition": "a1 | count() > 5"}) == ["2.0", "3.0", "4.0"]


def test_scan_counts_and_samples(spark):
    rules = [
        sigma_rule({"title": "A lookups", "id": "r1", "level": "high", "logsource": {"service": "dns"},
                    "tags": ["attack.t1071.004", "attack.command-and-control", "attack.s0001"],
                    "detection": {"selection": A, "condition": "selection"}}),
        sigma_rule({"title": "never", "id": "r2", "logsource": {"service": "dns"},
                    "detection": {"selection": {"query": "none"}, "condition": "selection"}}),
        sigma_rule({"title": "other log", "id": "r3", "logsource": {"service": "http"},
                    "detection": {"selection": A, "condition": "selection"}}),
    ]
    got = {r.capture_id: r for r in sigma.sigma_scan({"dns": spark.createDataFrame(ROWS, SCHEMA)}, rules).collect()}
    assert (got["c"].match_count, got["c"].sample_src_ips, got["c"].sample_dst_ips) == (2, ["10.0.0.2", "10.0.0.1"], ["8.8.8.8", "9.9.9.9"])
    assert (got["d"].match_count, got["d"].sample_dst_ips, got["d"].techniques) == (1, [], ["T1071.004"])
    assert got["c"].tactics == ["command_and_control"] and len(got) == 2


def test_samples_are_five_by_first_sight(spark):
    rows = [("c", str(100 - i), f"10.0.0.{i}", "8.8.8.8", "q", "A") for i in range(20)] * 3
    rule = sigma_rule({"title": "t", "id": "i", "logsource": {"service": "dns"}, "detection": {"selection": A}})
    row = sigma.sigma_scan({"dns": spark.createDataFrame(rows, SCHEMA)}, [rule]).first()
    assert row.match_count == 60 and row.sample_src_ips == [f"10.0.0.{i}" for i in (19, 18, 17, 16, 15)]


def test_tags():
    assert parse_tags(["attack.t1003", "attack.credential-access", "attack.s0002", "cve.2020"]) == (["T1003"], ["credential_access"])


def test_loader_skips_unsupported_rules(spark, tmp_path):
    (tmp_path / "good.yml").write_text("title: g\nlogsource: {service: dns}\ndetection: {selection: {query: x}, condition: selection}\n")
    (tmp_path / "list.yaml").write_text("title: l\nlogsource: {service: dns}\ndetection: {selection: [{query: x}], condition: selection}\n")
    with pytest.warns(UserWarning, match="list.yaml"):
        assert [r.title for r in load_sigma(spark, str(tmp_path))] == ["g"]


def test_builtin_rules_compile(spark):
    from netquarry.schemas import ZEEK_LOGS, column_name

    rules = load_sigma(spark)
    assert len(rules) == 5
    for rule in rules:
        assert sigma.compile_rule(rule, [column_name(f) for f in ZEEK_LOGS[rule.service]]) is not None
    assert sigma.rule_fields(rules, "smb_mapping") == ["orig_h", "path"]


@pytest.mark.parametrize(("pattern", "found"), [
    (r"(?P<first_part>good)\.", ["2.0"]),
    (r"(?P<x>e)v.*(?P=x)xample", ["1.0"]),
    (r"\.ORG\Z", ["2.0"]),
])
def test_patterns_of_the_other_dialect(spark, pattern, found):
    assert hits(spark, {"s": {"query|re": pattern}, "condition": "s"}) == found


def test_a_hopeless_pattern_does_not_end_the_scan(spark):
    # The first is fine for one engine alone, the second for none.
    rules = [sigma_rule({"title": t, "id": t, "logsource": {"service": "dns"}, "detection": {"s": {"query|re": p}, "condition": "s"}})
             for t, p in (("a", r"(?P<n>g)(?(n)ood|x)"), ("b", "["), ("c", r"^evil"))]
    with pytest.warns(UserWarning, match="skipped"):
        got = sigma.scan_log(spark.createDataFrame(ROWS, SCHEMA), rules).collect()
    assert [(r.rule_id, r.match_count, r.sample_dst_ips) for r in got] == [("c", 1, ["8.8.8.8"])]
