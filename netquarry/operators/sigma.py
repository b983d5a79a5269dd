"""Log rules: named groups of field tests under a condition, compiled to column expressions."""

from __future__ import annotations

import re
import warnings
from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.operators.common import CAPTURE, count_if, top_k
from netquarry.schemas import column_name
from netquarry.session import local_table
from netquarry.sources.rules import SigmaRule

# The logs rules can name.
SIGMA_LOGS = (
    "x509", "ssl", "dns", "http", "smb_files", "smb_mapping", "dce_rpc", "kerberos", "conn",
    "ssh", "ftp", "rdp", "ntlm",
)
SAMPLE_IPS = 5


def rule_fields(rules: list[SigmaRule], service: str) -> list[str]:
    """Fields the rules of one log name, for reading them beside the standard ones."""
    return sorted(
        {field for r in rules if r.service == service for items in r.groups.values() for field, _, _ in items}
    )


def find_column(field: str, columns: list[str]) -> str | None:
    """Column of a rule field, by name first and ignoring case second."""
    for name in (field, column_name(field)):
        if name in columns:
            return name
    lowered = {c.lower(): c for c in columns}
    return lowered.get(field.lower()) or lowered.get(column_name(field).lower())


def java_pattern(plain: str) -> str | None:
    """A rule's pattern, without regard to case, as the engine of rlike reads it; None, with a warning, if it can't."""
    try:
        re.compile(plain)
    except re.error as error:
        warnings.warn(f"pattern {plain!r} skipped: {error}", stacklevel=2)
        return None
    # Names of groups have letters and digits only there, and the end of a text is written in lower case.
    named = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', 'u')}>", plain)
    named = re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\k<{m[1].replace('_', 'u')}>", named)
    pattern = "(?i)" + re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", named)
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException as error:
        warnings.warn(f"pattern {plain!r} skipped: {error}", stacklevel=2)
        return None
    return pattern


def compile_item(field: str, modifiers: tuple, values: tuple, columns: list[str]) -> Column:
    """One field test. Values are alternatives, or all needed with ``all``.

    A null field reads as ''. Only ``contains`` and ``re`` ignore case.
    """
    name = find_column(field, columns)
    if name is None:
        return F.lit(False)
    text = F.coalesce(F.col(name).cast("string"), F.lit(""))
    tests = []
    for value in values:
        if value is None:
            continue
        if isinstance(value, bool):
            value = str(value).lower()
        plain = str(value)
        if "contains" in modifiers:
            plain = plain.strip("*")
            test = F.lower(text).contains(plain.lower())
        elif "startswith" in modifiers:
            plain = plain.rstrip("*")
            test = text.startswith(plain)
        elif "endswith" in modifiers:
            plain = plain.lstrip("*")
            test = text.endswith(plain)
        elif "re" in modifiers:
            pattern = java_pattern(plain)
            if pattern is None:
                continue
            test = text.rlike(pattern)
        else:
            plain = plain.strip("*")
            test = text == plain
        if plain:
            tests.append(test)
    if not tests:
        return F.lit(False)
    join = (lambda a, b: a & b) if "all" in modifiers else (lambda a, b: a | b)
    return reduce(join, tests)


def compile_group(items: list, columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [compile_item(*item, columns) for item in items], F.lit(True))


def compile_rule(rule: SigmaRule, columns: list[str]) -> Column | None:
    """The condition as a boolean column; None when it names no group at all."""
    groups = {name: compile_group(items, columns) for name, items in rule.groups.items()}
    condition = rule.condition

    def group(name: str) -> Column:
        return groups.get(name, F.lit(False))

    if condition in groups:
        return groups[condition]
    if condition == "all of them":
        return reduce(lambda a, b: a & b, groups.values(), F.lit(True))
    if m := re.fullmatch(r"1 of (\w+)\*", condition):
        chosen = [c for name, c in groups.items() if name.startswith(m.group(1))]
        return reduce(lambda a, b: a | b, chosen) if chosen else None
    if m := re.fullmatch(r"(\w+) and not (\w+)", condition):
        return group(m.group(1)) & ~group(m.group(2))
    if m := re.fullmatch(r"(\w+) (and|or) (\w+)", condition):
        left, right = group(m.group(1)), group(m.group(3))
        return left & right if m.group(2) == "and" else left | right
    warnings.warn(f"condition {condition!r} of {rule.title!r} read as its first group", stacklevel=2)
    return next(iter(groups.values()), None)


HIT_SCHEMA = (
    "capture_id string, rule_title string, rule_id string, level string, "
    "techniques array<string>, tactics array<string>, log_type string, match_count bigint, "
    "sample_src_ips array<string>, sample_dst_ips array<string>"
)


def scan_log(log: DataFrame, rules: list[SigmaRule]) -> DataFrame | None:
    """Matches of all rules of one log, found in one pass over it.

    Rows are reduced to (rule, side, address) counts on the map side, so neither a rule
    that matches most rows nor its address list gathers in one task.
    """
    columns = [c for c in log.columns if c != CAPTURE]
    compiled = [(i, compile_rule(r, columns)) for i, r in enumerate(rules)]
    compiled = [(i, c) for i, c in compiled if c is not None]
    if not compiled:
        return None
    tests = [F.when(c, F.lit(i)) for i, c in compiled]
    order = F.col("ts").try_cast("double") if "ts" in columns else F.lit(None).cast("double")

    def side(name: str, column: str) -> Column:
        ip = F.col(column).cast("string") if column in columns else F.lit(None).cast("string")
        return F.struct(F.lit(name).alias("side"), ip.alias("ip"))

    # Rows that no rule names go before any list is made.
    counted = (
        log.where(reduce(lambda a, b: a | b, [c for _, c in compiled]))
        .select(
            CAPTURE,
            order.alias("ts"),
            F.array(side("src", "orig_h"), side("dst", "resp_h")).alias("sides"),
            (F.explode(F.array(*tests)) if len(tests) > 1 else tests[0]).alias("rule"),
        )
        .where("rule IS NOT NULL")
        .select(CAPTURE, "ts", "rule", F.inline("sides"))
        .groupBy(CAPTURE, "rule", "side", "ip")
        .agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))
    )
    # Both reductions read the same columns of the same aggregate, so its shuffle is reused.
    totals = counted.groupBy(CAPTURE, "rule").agg(
        F.sum(F.when(F.col("side") == "src", F.col("n")).otherwise(0)).alias("match_count"),
        F.min("first_ts").alias("first_ts"),
    )
    order_by = [F.col("ip").isNull(), F.asc_nulls_last("first_ts"), F.asc("ip")]
    first = top_k(counted, [CAPTURE, "rule", "side"], order_by, SAMPLE_IPS, rank="position")

    def sample(name: str) -> Column:
        shown = (F.col("side") == name) & F.col("ip").isNotNull()
        entries = F.collect_list(F.when(shown, F.struct("position", "ip", "n")))
        return F.transform(F.array_sort(entries), lambda e: e["ip"])

    samples = first.groupBy(CAPTURE, "rule").agg(
        sample("src").alias("sample_src_ips"), sample("dst").alias("sample_dst_ips")
    )
    about = local_table(
        log.sparkSession,
        [
            {
                "rule": i, "rule_title": r.title, "rule_id": r.rule_id, "level": r.level,
                "techniques": r.techniques, "tactics": r.tactics, "log_type": r.service,
            }
            for i, r in enumerate(rules)
        ],
        "rule int, rule_title string, rule_id string, level string, techniques array<string>, "
        "tactics array<string>, log_type string",
    )
    empty = F.array().cast("array<string>")
    return totals.join(samples, [CAPTURE, "rule"], "left").join(about, "rule").select(
        CAPTURE, "rule_title", "rule_id", "level", "techniques", "tactics", "log_type", "match_count",
        F.coalesce("sample_src_ips", empty).alias("sample_src_ips"),
        F.coalesce("sample_dst_ips", empty).alias("sample_dst_ips"),
    )


def sigma_scan(logs: dict[str, DataFrame], rules: list[SigmaRule]) -> DataFrame | None:
    """Hits of all rules over all logs; None when no rule applies to a given log."""
    parts = []
    for service in SIGMA_LOGS:
        chosen = [r for r in rules if r.service == service]
        if chosen and service in logs:
            part = scan_log(logs[service], chosen)
            parts += [part] if part is not None else []
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else None


def sigma_stats(hits: DataFrame) -> DataFrame:
    """Rules hit, high-level rules hit, matched rows and techniques per capture."""
    return hits.groupBy(CAPTURE).agg(
        F.count("*").alias("rules_hit"),
        count_if(F.col("level") == "high").alias("high_hits"),
        F.sum("match_count").alias("alert_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("techniques")))).alias("techniques"),
    )
