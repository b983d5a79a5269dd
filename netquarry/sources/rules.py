"""Playbooks, allow-lists and log rules from YAML files."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, field
from decimal import Decimal
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from netquarry.functions.net import cidr_bounds
from netquarry.session import local_table
from netquarry.sources.files import load_yaml, read_texts

BUILTIN = Path(__file__).resolve().parents[1] / "rules"

RULES = (
    "ttp_id string, name string, category string, mitre_tactic string, "
    "confidence_ceiling string, fp_notes string"
)
GATES = "ttp_id string, position int, field string, minimum double"
RULE_SIGNALS = (
    "ttp_id string, position int, signal_id string, source string, attack_category string, "
    "op string, rhs double, rhs_bool boolean, weight decimal(6,4), "
    "low_op string, low_rhs double, low_rhs_bool boolean, low_weight decimal(6,4)"
)
BONUSES = "ttp_id string, bonus_id int, required array<string>, bonus decimal(6,4)"


@dataclass(frozen=True)
class Rules:
    """The four rule tables, and optionally their nested form (see scoring.nested_rules)."""

    rules: DataFrame
    gates: DataFrame
    signals: DataFrame
    bonuses: DataFrame
    nested: DataFrame | None = None


def _nested_ddl() -> str:
    def array(name: str, ddl: str) -> str:
        fields = [f.strip().split(" ", 1) for f in re.split(r", (?![^(]*\))", ddl)][1:]
        return f"{name} array<struct<" + ", ".join(f"{n}: {t}" for n, t in fields) + ">>"

    return ", ".join([RULES, array("gates", GATES), array("signals", RULE_SIGNALS), array("bonuses", BONUSES)])


def parse_threshold(text) -> tuple[str | None, float | None, bool]:
    """'>= 5' -> ('>=', 5.0, False), '== True' -> ('==', 1.0, True); else (None, None, False)."""
    match = re.match(r"([<>]=?|==|!=)\s*(.+)", str(text or "").strip())
    if not match:
        return None, None, False
    op, right = match.group(1), match.group(2).strip()
    try:
        return op, float(right), False
    except ValueError:
        pass
    if right in ("True", "true", "False", "false"):
        return op, float(right in ("True", "true")), True
    return None, None, False


def _weight(value) -> Decimal:
    return Decimal(str(value or 0)).quantize(Decimal("0.0001"))


def rules_from_dicts(spark: SparkSession, playbooks: list[dict]) -> Rules:
    """Rule tables from parsed playbooks."""
    rules, gates, signals, bonuses = [], [], [], []
    for book in playbooks:
        ttp = str(book["ttp_id"])
        rules.append({
            "ttp_id": ttp,
            "name": book.get("name", ""),
            "category": book.get("category", ""),
            "mitre_tactic": book.get("mitre_tactic", ""),
            "confidence_ceiling": book.get("confidence_ceiling"),
            "fp_notes": str(book.get("false_positive_notes", "")).strip(),
        })
        for i, (name, minimum) in enumerate((book.get("minimum_presence") or {}).items()):
            gates.append({"ttp_id": ttp, "position": i, "field": name, "minimum": float(minimum)})
        for i, sig in enumerate(book.get("signals") or []):
            if not sig.get("source") or not sig.get("threshold"):
                continue
            op, rhs, is_bool = parse_threshold(sig["threshold"])
            low_op, low_rhs, low_bool = parse_threshold(sig.get("threshold_low"))
            low = _weight(sig.get("weight_low"))
            signals.append({
                "ttp_id": ttp, "position": i, "signal_id": sig.get("id", ""),
                "source": sig["source"], "attack_category": sig.get("attack_category") or None,
                "op": op, "rhs": rhs, "rhs_bool": is_bool, "weight": _weight(sig.get("weight")),
                "low_op": low_op if low > 0 else None, "low_rhs": low_rhs,
                "low_rhs_bool": low_bool, "low_weight": low,
            })
        for i, bonus in enumerate(book.get("combination_bonuses") or []):
            bonuses.append({
                "ttp_id": ttp, "bonus_id": i, "required": list(bonus.get("signals") or []),
                "bonus": _weight(bonus.get("bonus")),
            })
    def of(rows: list[dict], ttp: str) -> list[dict]:
        return [{k: v for k, v in r.items() if k != "ttp_id"} for r in rows if r["ttp_id"] == ttp]

    nested = [
        r | {"gates": of(gates, r["ttp_id"]), "signals": of(signals, r["ttp_id"]), "bonuses": of(bonuses, r["ttp_id"])}
        for r in rules
    ]
    return Rules(
        local_table(spark, rules, RULES),
        local_table(spark, gates, GATES),
        local_table(spark, signals, RULE_SIGNALS),
        local_table(spark, bonuses, BONUSES),
        local_table(spark, nested, _nested_ddl()),
    )


def _yaml_texts(spark: SparkSession, path: str | None, pattern: str, builtin: str):
    if path is not None:
        return read_texts(spark, path, pattern)
    return [(str(p), p.read_text()) for p in sorted((BUILTIN / builtin).rglob(pattern))]


def playbook_dicts(spark: SparkSession, path: str | None = None) -> list[dict]:
    """Playbook documents of all ``*.yaml`` below a directory, the built-in ones by default.

    A file may hold several documents. Documents without ``ttp_id`` are ignored, a file
    that cannot be parsed is skipped with a warning.
    """
    books = []
    for name, text in _yaml_texts(spark, path, "*.yaml", "playbooks"):
        try:
            documents = load_yaml(text)
        except ImportError:
            raise
        except Exception as error:
            warnings.warn(f"playbook {name} skipped: {error}", stacklevel=2)
            continue
        books += [d for d in documents if isinstance(d, dict) and "ttp_id" in d]
    return books


def load_playbooks(spark: SparkSession, path: str | None = None) -> Rules:
    return rules_from_dicts(spark, playbook_dicts(spark, path))


@dataclass(frozen=True)
class Allowlist:
    """Known-good networks and domains, and local protocols."""

    nets: DataFrame
    domains: DataFrame
    protocols: list[str]
    rule_count: int


def load_allowlist(spark: SparkSession, path: str | None = None) -> Allowlist:
    """Allow-list from YAML; bad networks are skipped, names lower-cased."""
    texts = _yaml_texts(spark, path, "*.yaml", "allowlist")
    documents = [d for _, text in texts for d in load_yaml(text)]
    cidrs, domains, protocols = [], [], []
    for doc in documents:
        updates = doc.get("update_servers") or {}
        cidrs += doc.get("ntp_servers") or []
        cidrs += doc.get("cdn_ranges") or []
        cidrs += updates.get("ips") or []
        domains += updates.get("domains") or []
        domains += doc.get("certificate_authorities") or []
        protocols += doc.get("local_protocols_to_clear") or []
    bounds = [b for b in map(cidr_bounds, cidrs) if b]
    names = sorted({str(d).lower() for d in domains})
    return Allowlist(
        networks(spark, cidrs),
        local_table(spark, [{"domain": d} for d in names], "domain string"),
        sorted({str(p).lower() for p in protocols}),
        len(bounds) + len(names),
    )


def networks(spark: SparkSession, cidrs: list[str]) -> DataFrame:
    """CIDR texts as (lo, hi, prefix_len) rows."""
    rows = [
        {"lo": b[0], "hi": b[1], "prefix_len": b[2]} for b in map(cidr_bounds, cidrs) if b
    ]
    return local_table(spark, rows, "lo bigint, hi bigint, prefix_len int")


@dataclass(frozen=True)
class SigmaRule:
    """One log rule: named groups of (field, modifiers, values) and a condition over them."""

    title: str
    rule_id: str
    level: str
    service: str
    condition: str
    groups: dict[str, list[tuple[str, tuple[str, ...], tuple]]]
    techniques: list[str] = field(default_factory=list)
    tactics: list[str] = field(default_factory=list)


def parse_tags(tags) -> tuple[list[str], list[str]]:
    """ATT&CK tags to techniques (T1071.004) and tactics (credential_access)."""
    techniques, tactics = [], []
    for tag in tags or []:
        name = str(tag).lower()
        if not name.startswith("attack."):
            continue
        name = name.removeprefix("attack.")
        if re.match(r"t\d", name):
            techniques.append(name.upper())
        elif not name.startswith("s"):
            tactics.append(name.replace("-", "_"))
    return techniques, tactics


def sigma_rule(doc: dict) -> SigmaRule:
    """A rule from its YAML document; ValueError for forms that are not supported."""
    detection = dict(doc["detection"])
    condition = detection.pop("condition", "selection")
    if isinstance(condition, list):
        condition = condition[0] if condition else "selection"
    groups = {}
    for name, body in detection.items():
        if name == "timeframe":
            continue
        if not isinstance(body, dict):
            raise ValueError(f"group {name} is not a map of fields")
        items = []
        for key, values in body.items():
            column, *modifiers = str(key).split("|")
            values = values if isinstance(values, list) else [values]
            items.append((column, tuple(modifiers), tuple(values)))
        groups[name] = items
    techniques, tactics = parse_tags(doc.get("tags"))
    return SigmaRule(
        title=str(doc.get("title", "")),
        rule_id=str(doc.get("id", "")),
        level=str(doc.get("level", "")).lower(),
        service=str((doc.get("logsource") or {}).get("service") or ""),
        condition=str(condition).strip(),
        groups=groups,
        techniques=techniques,
        tactics=tactics,
    )


def load_sigma(spark: SparkSession, path: str | None = None) -> list[SigmaRule]:
    """Rules of all ``*.yml`` and ``*.yaml`` files; a rule that cannot be parsed is skipped."""
    texts = _yaml_texts(spark, path, "*.yml", "sigma") + _yaml_texts(spark, path, "*.yaml", "sigma")
    rules = []
    for name, text in texts:
        try:
            rules += [sigma_rule(doc) for doc in load_yaml(text)]
        except ImportError:
            raise
        except Exception as error:
            warnings.warn(f"log rule {name} skipped: {error}", stacklevel=2)
    return rules
