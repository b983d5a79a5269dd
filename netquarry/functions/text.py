"""String expressions: entropy, DNS names, alert text, paths, sizes."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from netquarry.functions.lists import (
    ALERT_TECHNIQUES,
    HIGH_RISK_TLDS,
    NAME_KEYWORDS,
)

ENCODED_LABEL = r"^[A-Za-z0-9+/=_-]{24,}$"
B64_RUN = r"[A-Za-z0-9+/]{24,}={0,2}"
ADMIN_SHARES = ("ADMIN$", "C$", "IPC$")


def shannon_entropy(c: Column) -> Column:
    """Bits per character; null and '' give 0."""
    s = F.coalesce(c, F.lit(""))
    n = F.length(s).cast("double")
    chars = F.filter(F.array_distinct(F.split(s, "")), lambda ch: ch != "")

    def add(acc: Column, ch: Column) -> Column:
        p = (n - F.length(F.replace(s, ch, F.lit("")))) / n
        return acc + p * F.log2(p)

    return F.when(n > 0, F.lit(0.0) - F.aggregate(chars, F.lit(0.0), add)).otherwise(F.lit(0.0))


def first_label(c: Column) -> Column:
    return F.split_part(c, F.lit("."), F.lit(1))


def label_count(c: Column) -> Column:
    return F.size(F.split(c, r"\."))


def is_srv(c: Column) -> Column:
    """Service records: some label starts with an underscore."""
    return c.startswith("_") | c.contains("._")


def is_mdns(c: Column) -> Column:
    return c.endswith(".local")


def entropy_eligible(c: Column) -> Column:
    return ~is_mdns(c) & (label_count(c) >= 3)


def parent_domain(c: Column) -> Column:
    """Last two labels; null for a single label."""
    return F.when(c.contains("."), F.substring_index(c, ".", -2))


def is_suspicious_name(c: Column) -> Column:
    """Once-seen names worth a look: risky TLD, delivery keyword, or random-looking stem."""
    name = F.regexp_replace(F.lower(c), r"\.+$", "")
    labels = F.split(name, r"\.")
    n = F.size(labels)
    stem = F.get(labels, n - 2)
    tld = F.get(labels, n - 1)
    excluded = name.endswith(".local") | name.endswith(".arpa") | is_srv(name) | (n < 2)
    keyword = F.replace(name, F.lit("."), F.lit("")).rlike("|".join(NAME_KEYWORDS))
    random_stem = (F.length(stem) >= 8) & (shannon_entropy(stem) > 3.5)
    hit = tld.isin(*HIGH_RISK_TLDS) | keyword | random_stem
    return F.coalesce(~excluded & hit, F.lit(False))


def has_encoded_label(c: Column) -> Column:
    """A label of 24+ base64url characters with entropy above 4 bits."""
    encoded = F.exists(
        F.split(c, r"\."),
        lambda lab: lab.rlike(ENCODED_LABEL) & (shannon_entropy(lab) > 4.0),
    )
    return F.coalesce(~is_srv(c) & ~is_mdns(c) & encoded, F.lit(False))


def has_b64_run(c: Column) -> Column:
    return F.coalesce(c.rlike(B64_RUN), F.lit(False))


def domain_in(c: Column, domains: Iterable[str]) -> Column:
    """Equals or lies below one of a short literal list (already lower-case)."""
    tests = [(c == d) | c.endswith("." + d) for d in domains]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def name_suffixes(c: Column) -> Column:
    """All suffixes of a name at label borders, longest first: a.b.c -> [a.b.c, b.c, c]."""
    labels = F.split(c, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def is_admin_share(c: Column) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [F.upper(c).contains(s) for s in ADMIN_SHARES]), F.lit(False))


def signature_to_technique(c: Column) -> Column:
    """First pattern of the ordered table contained in the alert text, any case."""
    text = F.upper(c)
    pattern, technique = ALERT_TECHNIQUES[0]
    expr = F.when(text.contains(pattern.upper()), technique)
    for pattern, technique in ALERT_TECHNIQUES[1:]:
        expr = expr.when(text.contains(pattern.upper()), technique)
    return expr


def domains_in_text(c: Column) -> Column:
    """Domains written in parentheses, spaces removed, lower-cased."""
    raw = F.regexp_extract_all(
        c, F.lit(r"(?i)\(([a-z0-9][a-z0-9\-._]{2,}\s*\.[a-z]{2,10})\)"), F.lit(1)
    )
    return F.transform(raw, lambda d: F.lower(F.replace(d, F.lit(" "), F.lit(""))))


def family_from_text(c: Column) -> Column:
    """Malware family named in alert text, null when none."""
    def pick(pattern: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract(c, pattern, 1)), F.lit(""))

    return F.coalesce(
        pick(r"(Win\d+/[\w\s]+?\w)"),
        pick(r"ET MALWARE ([\w\s/]+?) (?:C2|Related|Victim|CnC)"),
    )


def unc_server(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^\\\\([^\\]+)", 1), F.lit(""))


def unc_domain(c: Column) -> Column:
    """Directory domain from \\\\HOST.domain.tld\\share; needs three labels or more."""
    labels = F.split(unc_server(c), r"\.")
    return F.when(F.size(labels) >= 3, F.lower(F.array_join(F.slice(labels, F.lit(2), F.size(labels)), ".")))


def smb_path(path: Column, name: Column) -> Column:
    joined = F.concat(F.coalesce(path, F.lit("")), F.lit("\\"), F.coalesce(name, F.lit("")))
    return F.regexp_replace(joined, r"^\\+|\\+$", "")


def principal_name(c: Column) -> Column:
    return F.split_part(c, F.lit("/"), F.lit(1))


def principal_realm(c: Column) -> Column:
    return F.lower(F.nullif(F.split_part(c, F.lit("/"), F.lit(2)), F.lit("")))


def is_machine_account(c: Column) -> Column:
    return principal_name(c).endswith("$")


def parse_bytes(c: Column) -> Column:
    """'570 kB' -> 570000; text without a leading number is 0."""
    text = F.trim(c)
    number = F.regexp_extract(text, r"^([0-9.]+)\s*(\w*)", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(text, r"^([0-9.]+)\s*(\w*)", 2))
    factor = (
        F.when(unit == "kb", 1e3).when(unit == "mb", 1e6).when(unit == "gb", 1e9).otherwise(1.0)
    )
    return F.coalesce((number * factor).cast("bigint"), F.lit(0).cast("bigint"))


def format_bytes(c: Column) -> Column:
    """1234 -> '1.2 KB'. Ties go to the even digit."""
    n = c.cast("double")

    def shown(scale: float, unit: str) -> Column:
        return F.format_string(f"%.1f {unit}", F.bround(n / scale, 1))

    expr = F.when(n < 1024, shown(1.0, "B"))
    scale = 1024.0
    for unit in ("KB", "MB", "GB"):
        expr = expr.when(n < scale * 1024, shown(scale, unit))
        scale *= 1024
    return expr.otherwise(shown(scale, "TB"))


def epoch_text(c: Column) -> Column:
    """Epoch seconds to 'yyyy-MM-dd HH:mm:ss' in the session time zone."""
    return F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd HH:mm:ss")
