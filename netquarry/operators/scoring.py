"""Technique scoring: rule tables against per-capture signals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions.lists import CONFIDENCE_RANK
from netquarry.functions.score import compare
from netquarry.operators.common import CAPTURE
from netquarry.sources.rules import Rules

REPORT_THRESHOLD = 0.35
DEEP_DIVE_THRESHOLD = 0.60
BOOST = 0.10


def confidence_rank(c: Column) -> Column:
    """Rank of a confidence name, 0 is best; unknown names rank last."""
    expr = F.when(c == "CONFIRMED", 0)
    for name, rank in list(CONFIDENCE_RANK.items())[1:]:
        expr = expr.when(c == name, rank)
    return expr.otherwise(99)


def nested_rules(rules: Rules) -> DataFrame:
    """One row per rule with its gates, signals and bonuses as arrays in file order."""
    if rules.nested is not None:
        return rules.nested

    def grouped(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c != "ttp_id"]
        return df.groupBy("ttp_id").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))

    out = rules.rules
    for df, name in ((rules.gates, "gates"), (rules.signals, "signals"), (rules.bonuses, "bonuses")):
        out = out.join(grouped(df, name), "ttp_id", "left")
    return out


def _plain_number(c: Column) -> Column:
    whole = F.floor(c)
    return F.when(c == whole, whole.cast("string")).otherwise(c.cast("string"))


def score_rules(
    signals: DataFrame, rules: Rules, ioc_match: DataFrame | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    """Score of every rule for every capture.

    The rule tables are a fixed, small input: they come in as one array value, and each
    capture row is expanded to its rules in place. Nothing is shuffled.
    ``ioc_match`` names captures (and optionally ttp_id) with a confirmed indicator.
    ``carry`` names columns that are no signals and go along; every capture then keeps a row,
    with a null technique if there are no rules.
    """
    names = [c for c in signals.columns if c not in (CAPTURE, *carry)]
    expand = F.explode_outer if carry else F.explode
    values = F.map_from_arrays(
        F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("double") for n in names])
    )
    nested = nested_rules(rules)
    table = nested.agg(F.array_sort(F.collect_list(F.struct(*nested.columns)))).scalar()
    rows = (
        signals.select(CAPTURE, *carry, values.alias("v"), table.alias("rules"))
        .select(CAPTURE, *carry, "v", expand("rules").alias("r"))
        .select(CAPTURE, *carry, "v", "r.*")
    )
    if ioc_match is not None:
        keys = [c for c in (CAPTURE, "ttp_id") if c in ioc_match.columns]
        matched = ioc_match.select(*keys).distinct().withColumn("ioc_match", F.lit(True))
        rows = rows.join(matched, keys, "left")
    else:
        rows = rows.withColumn("ioc_match", F.lit(False))

    v = F.col("v")
    failed = F.filter(
        F.coalesce("gates", F.array().cast("array<struct<position:int,field:string,minimum:double>>")),
        lambda g: F.coalesce(v[g["field"]], F.lit(0.0)) < g["minimum"],
    )
    rows = rows.withColumn("failed", F.get(failed, F.lit(0))).withColumn(
        "failed_value", F.coalesce(v[F.col("failed.field")], F.lit(0.0))
    )
    skipped = F.col("failed").isNotNull()

    def evaluate(s: Column) -> Column:
        value = v[s["source"]]
        strong = compare(value, s["op"], s["rhs"], s["rhs_bool"])
        weak = compare(value, s["low_op"], s["low_rhs"], s["low_rhs_bool"])
        zero = F.lit(0).cast("decimal(6,4)")
        return F.struct(
            s["position"].alias("position"),
            s["signal_id"].alias("base_id"),
            F.when(strong, s["signal_id"]).when(weak, F.concat(s["signal_id"], F.lit("_weak"))).alias("fired_id"),
            F.when(strong, s["weight"]).when(weak, s["low_weight"]).otherwise(zero).alias("weight"),
            s["attack_category"].alias("category"),
            value.alias("value"),
        )

    seen = F.transform(F.filter("signals", lambda s: v[s["source"]].isNotNull()), evaluate)
    rows = rows.withColumn("seen", F.when(~skipped, seen)).withColumn(
        "fired", F.filter("seen", lambda s: s["fired_id"].isNotNull())
    )
    base_ids = F.transform("fired", lambda s: s["base_id"])
    granted = F.filter("bonuses", lambda b: F.size(F.array_except(b["required"], base_ids)) == 0)
    start = F.lit(0).cast("decimal(12,4)")

    def total(items: Column, part: str) -> Column:
        return F.coalesce(
            F.aggregate(items, start, lambda a, s: (a + s[part]).cast("decimal(12,4)")), start
        )

    raw = total(F.col("fired"), "weight") + total(granted, "bonus")
    # An id may occur twice in a rule; the later value is kept.
    last_of_id = F.filter(
        "seen",
        lambda s: s["position"]
        == F.array_max(F.transform(F.filter("seen", lambda t: t["base_id"] == s["base_id"]), lambda t: t["position"])),
    )
    fired_ids = F.transform("fired", lambda s: s["fired_id"])
    categories = F.array_sort(F.array_distinct(F.array_compact(F.transform("fired", lambda s: s["category"]))))
    no_ids = F.array().cast("array<string>")
    rows = rows.select(
        CAPTURE, "ttp_id", "name", "category", "mitre_tactic", "confidence_ceiling", "fp_notes",
        "ioc_match", *carry,
        skipped.alias("skipped"),
        F.when(skipped, 0.0).otherwise(F.least(raw, F.lit(1)).cast("double")).alias("score"),
        F.coalesce(fired_ids, no_ids).alias("signals_fired"),
        F.coalesce(categories, no_ids).alias("categories_hit"),
        F.when(
            skipped,
            F.concat(
                F.col("failed.field"), F.lit("="), _plain_number(F.col("failed_value")),
                F.lit(" < required "), _plain_number(F.col("failed.minimum")),
            ),
        ).otherwise("").alias("skip_reason"),
        F.map_from_entries(
            F.transform(last_of_id, lambda s: F.struct(s["base_id"], s["value"]))
        ).alias("raw_values"),
    )
    n, c = F.size("signals_fired"), F.size("categories_hit")
    level = (
        F.when((n >= 3) & (c >= 2) & F.coalesce("ioc_match", F.lit(False)), "CONFIRMED")
        .when((n >= 3) & (c >= 2), "HIGH")
        .when((n >= 2) & (c >= 1), "MEDIUM")
        .when(n >= 1, "LOW")
        .otherwise("ANOMALY")
    )
    ceiling = F.col("confidence_ceiling")
    capped = ceiling.isin(*CONFIDENCE_RANK) & (confidence_rank(level) < confidence_rank(ceiling))
    confidence = F.when(~F.col("skipped") & F.coalesce(capped, F.lit(False)), ceiling).otherwise(level)
    return rows.select(
        CAPTURE, "ttp_id", "name", "category", "mitre_tactic", "score", "signals_fired",
        "categories_hit", confidence.alias("confidence"), "skipped", "skip_reason",
        "raw_values", "fp_notes", *carry,
    )


def sweep(
    scores: DataFrame,
    alerts: DataFrame | None = None,
    sigma_hits: DataFrame | None = None,
    report_threshold: float = REPORT_THRESHOLD,
) -> DataFrame:
    """Findings: scores at the report threshold, then raised by confirming alerts and log rules.

    Only an exact technique match confirms. The threshold applies before the boosts, and a
    boost may pass the ceiling of its rule.
    """
    reported = ~F.col("skipped") & (F.col("score") >= report_threshold)
    return boost(scores.where(reported).drop("skipped", "skip_reason"), alerts, sigma_hits)


def confirmations(alerts: DataFrame | None, sigma_hits: DataFrame | None) -> DataFrame | None:
    """Techniques named by alerts and by log rules: two lists a capture, no longer than the known techniques."""
    parts = []
    nothing = F.lit(None).cast("string")
    if alerts is not None:
        parts.append(alerts.select(CAPTURE, F.col("technique").alias("a"), nothing.alias("r")))
    if sigma_hits is not None:
        parts.append(sigma_hits.select(CAPTURE, nothing.alias("a"), F.explode("techniques").alias("r")))
    if not parts:
        return None
    named = reduce(DataFrame.unionByName, parts).where("a IS NOT NULL OR r IS NOT NULL").distinct()
    return named.groupBy(CAPTURE).agg(F.collect_set("a").alias("_by_alert"), F.collect_set("r").alias("_by_rule"))


def boost(scores: DataFrame, alerts: DataFrame | None = None, sigma_hits: DataFrame | None = None) -> DataFrame:
    """Raise scores whose technique an alert, then a log rule, confirms.

    The confirmations meet the scores by capture, as which they are partitioned already.
    """
    marks = confirmations(alerts, sigma_hits)
    if marks is None:
        return scores
    columns = scores.columns
    out = scores.join(marks, CAPTURE, "left")
    for mark, note, always_note in (
        ("_by_alert", "suricata_signature_confirmed", False), ("_by_rule", "sigma_rule_confirmed", True),
    ):
        hit = F.coalesce(F.array_contains(mark, F.col("ttp_id")), F.lit(False))
        raised = hit & ~F.col("confidence").isin("CONFIRMED", "HIGH")
        noted = hit if always_note else raised
        score, fired = F.col("score"), F.col("signals_fired")
        changed = {
            "score": F.when(hit, F.least(F.lit(1.0), F.round(score + BOOST, 4))).otherwise(score),
            "signals_fired": F.when(noted, F.array_append(fired, F.lit(note))).otherwise(fired),
            "confidence": F.when(raised, "HIGH").otherwise(F.col("confidence")),
        }
        out = out.select(*[changed.get(c, F.col(c)).alias(c) for c in columns], "_by_alert", "_by_rule")
    return out.select(*columns)


def assessed_captures(
    signals: DataFrame,
    rules: Rules,
    alerts: DataFrame | None = None,
    sigma_hits: DataFrame | None = None,
    report_threshold: float = REPORT_THRESHOLD,
    strong_threshold: float = DEEP_DIVE_THRESHOLD,
) -> DataFrame:
    """The signals of each capture with the techniques of its findings.

    ``ttps_checked`` holds all of them by falling score, ``strong_ttps`` those at the strong threshold.
    The signals travel with their scores, so that both come from one tree and no join.
    """
    names = [c for c in signals.columns if c != CAPTURE]
    scores = score_rules(signals.withColumn("_signals", F.struct(*names)), rules, carry=["_signals"])
    reported = ~F.col("skipped") & (F.col("score") >= report_threshold)
    marked = scores.select(
        CAPTURE, "_signals", "ttp_id", "score", "confidence", "signals_fired", reported.alias("_reported")
    )
    found = F.when(F.col("_reported"), F.struct((-F.col("score")).alias("s"), "ttp_id"))
    strong = F.when(F.col("_reported") & (F.col("score") >= strong_threshold), F.col("ttp_id"))
    return (
        boost(marked, alerts, sigma_hits)
        .groupBy(CAPTURE)
        .agg(
            F.first("_signals").alias("_signals"),
            F.transform(F.array_sort(F.collect_list(found)), lambda e: e["ttp_id"]).alias("ttps_checked"),
            F.array_sort(F.collect_set(strong)).alias("strong_ttps"),
        )
        .select(CAPTURE, "_signals.*", "ttps_checked", "strong_ttps")
    )


def by_score(findings: DataFrame) -> DataFrame:
    """Report order of the sweep."""
    return findings.orderBy(CAPTURE, F.desc("score"), "ttp_id")


def by_confidence(findings: DataFrame) -> DataFrame:
    """Report order of the findings section: confidence, then score."""
    return findings.orderBy(CAPTURE, confidence_rank(F.col("confidence")), F.desc("score"), "ttp_id")
