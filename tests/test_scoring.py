"""Rule scoring against a small scorer of its own on random rules; sweep, boosts and orders."""

import operator
import random
from fractions import Fraction

import pytest

from netquarry.functions.lists import CONFIDENCE_RANK
from netquarry.operators import scoring, signals as sig
from netquarry.sources.rules import parse_threshold, playbook_dicts, rules_from_dicts

OPERATORS = {">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt, "==": operator.eq, "!=": operator.ne}
NUMBERS = [n for n, s in sig.REGISTRY.items() if isinstance(s.default, int) and not isinstance(s.default, bool)][:12]
FLAGS = [n for n, s in sig.REGISTRY.items() if isinstance(s.default, bool)][:4]


def signals(spark, *rows, **values):
    """A row per dict, or one row of capture c with the given values."""
    rows = rows or (values,)
    kinds = {bool: "boolean", int: "bigint", float: "double"}
    schema = "capture_id string, " + ", ".join(f"{n} {kinds[type(s.default)]}" for n, s in sig.REGISTRY.items())
    table = [(r.get("capture_id", "c"), *(r.get(n, s.default) for n, s in sig.REGISTRY.items())) for r in rows]
    return spark.createDataFrame(table, schema)


def random_threshold(rng, source):
    if source in FLAGS:
        return f"{rng.choice(['==', '!='])} {rng.choice(['True', 'False', 'true', 'false'])}"
    if rng.random() < 0.1:
        return rng.choice(["nearly 4", "", "=> 2", "== TRUE"])
    return rng.choice(list(OPERATORS)) + rng.choice(["", " "]) + str(rng.choice([0, 1, 2, 3, 5, 2.5]))


def random_rule(rng, number):
    """A rule with signals of every kind: unknown sources, bad thresholds, weak tiers, shared ids."""
    parts = []
    for k in range(rng.randint(0, 6)):
        source = rng.choice([*NUMBERS, *NUMBERS, *FLAGS, "not_a_signal"])
        part = {"id": f"p{k if rng.random() < 0.9 else 0}", "source": source, "threshold": random_threshold(rng, source),
                "weight": rng.randint(1, 70) / 100, "attack_category": rng.choice("XYZ")}
        if rng.random() < 0.4:
            part["threshold_low"] = random_threshold(rng, source)
        if rng.random() < 0.4:
            part["weight_low"] = rng.randint(1, 30) / 100
        parts.append(part)
    ids = [p["id"] for p in parts] + ["p9"]
    rule = {"ttp_id": f"R{number:03d}", "name": f"rule {number}", "category": "own", "mitre_tactic": "none", "signals": parts}
    if rng.random() < 0.6:
        rule["combination_bonuses"] = [
            {"signals": rng.sample(sorted(set(ids)), min(len(set(ids)), rng.randint(1, 3))), "bonus": rng.randint(1, 25) / 100}
            for _ in range(rng.randint(1, 3))]
    if rng.random() < 0.4:
        rule["minimum_presence"] = {rng.choice([*NUMBERS, "not_a_signal"]): rng.choice([0, 1, 2]) for _ in range(rng.randint(1, 2))}
    if rng.random() < 0.4:
        rule["confidence_ceiling"] = rng.choice(list(CONFIDENCE_RANK))
    if rng.random() < 0.5:
        rule["false_positive_notes"] = f"note {number}"
    return rule


def holds(value, threshold):
    op, rhs, is_flag = parse_threshold(threshold)
    return op is not None and OPERATORS[op](float(bool(value)) if is_flag else float(value), rhs)


def plain_score(rule, values, indicator):
    """(score, fired, confidence, skipped, raw values) by the wording of the rules."""
    for field, least in (rule.get("minimum_presence") or {}).items():
        if values.get(field, 0) < least:
            return 0.0, [], None, True, None
    fired, ids, groups, total, raw = [], set(), set(), Fraction(0), {}
    for p in rule["signals"]:
        if p["source"] not in values or not p["threshold"]:  # without a threshold it is no signal
            continue
        raw[p["id"]] = float(values[p["source"]])
        weight = None
        if holds(values[p["source"]], p["threshold"]):
            weight, name = p["weight"], p["id"]
        elif "threshold_low" in p and "weight_low" in p and holds(values[p["source"]], p["threshold_low"]):
            weight, name = p["weight_low"], p["id"] + "_weak"
        if weight is not None:
            fired.append(name)
            ids.add(p["id"])
            groups.add(p["attack_category"])
            total += Fraction(str(weight))
    total += sum(Fraction(str(b["bonus"])) for b in rule.get("combination_bonuses") or [] if set(b["signals"]) <= ids)
    level = "ANOMALY" if not fired else "LOW" if len(fired) < 2 else "MEDIUM" if len(fired) < 3 or len(groups) < 2 else "HIGH"
    if level == "HIGH" and indicator:
        level = "CONFIRMED"
    ceiling = rule.get("confidence_ceiling")
    if ceiling in CONFIDENCE_RANK and CONFIDENCE_RANK[level] < CONFIDENCE_RANK[ceiling]:
        level = ceiling
    return float(min(total, 1)), fired, level, False, raw


@pytest.mark.parametrize("seed", [1, 2])
def test_random_rules_equal_the_plain_scorer(spark, seed):
    rng = random.Random(seed)
    rules = [random_rule(rng, k) for k in range(80)]
    rows = []
    for c in range(8):
        row = {"capture_id": f"c{c}"} | {n: rng.choice([0, 1, 2, 3, 6]) for n in NUMBERS} | {n: rng.random() < 0.5 for n in FLAGS}
        rows.append(row)
    match = spark.createDataFrame([("c1",), ("c5",)], "capture_id string")
    got = scoring.score_rules(signals(spark, *rows), rules_from_dicts(spark, rules), match).collect()
    assert len(got) == len(rules) * len(rows)
    by_id, by_capture = {r["ttp_id"]: r for r in rules}, {r["capture_id"]: r for r in rows}
    seen = set()
    for r in got:
        values = {n: s.default for n, s in sig.REGISTRY.items()} | by_capture[r.capture_id]
        del values["capture_id"]
        rule = by_id[r.ttp_id]
        score, fired, level, skipped, raw = plain_score(rule, values, r.capture_id in ("c1", "c5"))
        assert (r.skipped, r.signals_fired, r.fp_notes) == (skipped, fired, rule.get("false_positive_notes", ""))
        assert r.score == pytest.approx(score, abs=1e-9)
        if skipped:
            field, least = r.skip_reason.split("=")[0], r.skip_reason.split("required ")[1]
            assert rule["minimum_presence"][field] == float(least) > values.get(field, 0)
        else:
            assert r.confidence == level and r.raw_values == raw and r.skip_reason == ""
        seen |= {r.confidence, skipped}
    assert seen >= {"ANOMALY", "LOW", "MEDIUM", "HIGH", "CONFIRMED", True, False}


def test_threshold_texts_round_trip():
    for op in OPERATORS:
        for number in (0, 7, 0.25, 1024):
            for gap in ("", " ", "  "):
                assert parse_threshold(f"{op}{gap}{number}") == (op, float(number), False)
        for word, value in (("True", 1.0), ("true", 1.0), ("False", 0.0), ("false", 0.0)):
            assert parse_threshold(f"{op} {word}") == (op, value, True)
    for text in ("7", "> >", ">=", "about 7", "== yes"):
        assert parse_threshold(text) == (None, None, False)


def test_builtin_rules_are_complete(spark):
    books = playbook_dicts(spark)
    assert len(books) == 29
    assert sum(len(b["signals"]) for b in books) == 84
    assert sum(len(b.get("combination_bonuses") or []) for b in books) == 48
    known = set(sig.REGISTRY)
    assert {s["source"] for b in books for s in b["signals"]} <= known
    assert {f for b in books for f in (b.get("minimum_presence") or {})} <= known


SCORES = (
    "capture_id string, ttp_id string, name string, category string, mitre_tactic string, score double, "
    "signals_fired array<string>, categories_hit array<string>, confidence string, skipped boolean, "
    "skip_reason string, raw_values map<string,double>, fp_notes string"
)


def scored(spark, *rows):
    return spark.createDataFrame(
        [(cap, ttp, ttp, "x", "TA", s, ["a"], ["A"], level, False, "", {}, "") for cap, ttp, s, level in rows], SCORES
    )


def test_sweep_filters_before_boosting(spark):
    scores = scored(spark, ("c", "T1", 0.34, "LOW"), ("c", "T2", 0.35, "LOW"))
    alerts = spark.createDataFrame([("c", "T1"), ("c", "T2")], "capture_id string, technique string")
    rows = scoring.sweep(scores, alerts).collect()
    assert [(r.ttp_id, r.score, r.confidence) for r in rows] == [("T2", 0.45, "HIGH")]
    assert rows[0].signals_fired == ["a", "suricata_signature_confirmed"]


def test_alert_boost_does_not_note_high_and_keeps_confirmed(spark):
    scores = scored(spark, ("c", "T1", 0.95, "HIGH"), ("c", "T2", 0.5, "CONFIRMED"))
    alerts = spark.createDataFrame([("c", "T1"), ("c", "T2")], "capture_id string, technique string")
    rows = {r.ttp_id: r for r in scoring.sweep(scores, alerts).collect()}
    assert rows["T1"].score == 1.0 and rows["T1"].signals_fired == ["a"]
    assert rows["T2"].confidence == "CONFIRMED" and rows["T2"].score == pytest.approx(0.6)


def test_boost_is_exact_and_per_capture(spark):
    scores = scored(spark, ("c", "T1071", 0.5, "LOW"), ("d", "T1071.004", 0.5, "LOW"))
    alerts = spark.createDataFrame([("c", "T1071.004"), ("d", "T1071")], "capture_id string, technique string")
    assert {r.score for r in scoring.sweep(scores, alerts).collect()} == {0.5}


def test_log_rule_boost_always_notes(spark):
    scores = scored(spark, ("c", "T1", 0.5, "HIGH"), ("c", "T2", 0.5, "MEDIUM"))
    hits = spark.createDataFrame([("c", ["T1", "T2"])], "capture_id string, techniques array<string>")
    rows = {r.ttp_id: r for r in scoring.sweep(scores, sigma_hits=hits).collect()}
    assert all(r.signals_fired[-1] == "sigma_rule_confirmed" and r.confidence == "HIGH" for r in rows.values())


def test_report_orders(spark):
    scores = scoring.sweep(scored(spark, ("c", "T1", 0.9, "LOW"), ("c", "T2", 0.5, "HIGH"), ("c", "T3", 0.7, "HIGH")))
    assert [r.ttp_id for r in scoring.by_score(scores).collect()] == ["T1", "T3", "T2"]
    assert [r.ttp_id for r in scoring.by_confidence(scores).collect()] == ["T3", "T2", "T1"]
