"""Evidence behind findings. Every table holds a bounded number of rows per capture."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions import text
from netquarry.operators.common import CAPTURE, top_k
from netquarry.operators.packets import sample_rows
from netquarry.operators.scoring import DEEP_DIVE_THRESHOLD
from netquarry.operators.signals import conn_rollup, scan_candidates

ARRAY_PREVIEW = 6
# Events of the scan timeline, in order.
TIMELINE = ("scan_start", "scan_end", "duration_secs")


def _first_values(rows: DataFrame, key: list[str], value: str, k: int, name: str) -> DataFrame:
    """The k smallest distinct values per key as a sorted array.

    Groups are cut to k rows on the map side, before they are gathered.
    """
    distinct = rows.where(F.col(value).isNotNull()).select(*key, value).distinct()
    first = top_k(distinct, key, [F.asc(value)], k)
    return first.groupBy(*key).agg(F.sort_array(F.collect_list(value)).alias(name))


def scan_evidence(conn: DataFrame, sources: DataFrame) -> DataFrame:
    """The top scanner of each capture: ports (first 50), targets (first 20), time span.

    Only the reduction of the top scanners, one source per capture, is made distinct and ranked.
    """
    top = scan_candidates(sources, 1)
    key = [CAPTURE, "src"]
    rollup = conn_rollup(conn).select(CAPTURE, F.col("orig_h").alias("src"), "resp_h", "resp_p")
    rollup = rollup.join(top.select(*key), key, "left_semi")
    ports = _first_values(rollup, key, "resp_p", 50, "unique_dst_ports_sample")
    targets = _first_values(rollup, key, "resp_h", 20, "unique_dst_hosts_sample")
    return (
        top.join(ports, key, "left")
        .join(targets, key, "left")
        .select(
            CAPTURE,
            F.col("src").alias("scanner_ip"),
            F.col("unique_dst_ports").alias("unique_dst_ports_count"),
            F.col("unique_dst_ports_sample").alias("unique_dst_ports"),
            F.col("unique_dst_hosts").alias("unique_dst_hosts_count"),
            "unique_dst_hosts_sample",
            "total_connections",
            F.col("first_ts").alias("scan_start"),
            F.col("last_ts").alias("scan_end"),
            (F.col("last_ts") - F.col("first_ts")).alias("duration_secs"),
        )
    )


def scan_timeline(evidence: DataFrame) -> DataFrame:
    """Timeline events of the scan evidence."""
    return evidence.select(CAPTURE, *TIMELINE).unpivot([CAPTURE], list(TIMELINE), "event", "ts")


def smb_share_evidence(smb_mapping: DataFrame, k: int = 20) -> DataFrame:
    rows = smb_mapping.where(text.is_admin_share(F.col("path")))
    return top_k(rows, [CAPTURE], [F.asc("ts"), F.asc("uid")], k, rank="position")


def smb_paths(smb_mapping: DataFrame, k: int = 10) -> DataFrame:
    """Distinct share paths by first use."""
    paths = smb_mapping.where("path IS NOT NULL").groupBy(CAPTURE, "path").agg(
        F.min("ts").alias("first_ts"), F.count("*").alias("uses")
    )
    return top_k(paths, [CAPTURE], [F.asc("first_ts"), F.asc("path")], k, rank="position")


def smb_file_evidence(smb_files: DataFrame, k: int = 20) -> DataFrame:
    rows = smb_files.select(CAPTURE, "ts", "uid", "orig_h", "resp_h", "action", "path", "name", "size")
    return top_k(rows, [CAPTURE], [F.asc("ts"), F.asc("uid")], k, rank="position")


def dns_evidence(dns: DataFrame, k: int = 30, minimum: float = 3.5) -> DataFrame:
    """Lookups with the most random-looking first labels."""
    query = F.col("query")
    entropy = F.when(query.contains("."), text.shannon_entropy(text.first_label(query))).otherwise(0.0)
    rows = dns.select(
        CAPTURE, "ts", "uid", "orig_h", "query", "qtype_name", "rcode_name", entropy.alias("entropy")
    ).where(F.col("entropy") > minimum)
    # Equal letter counts give sums that differ in the last bit; rounding makes them ties.
    order = [F.desc(F.round("entropy", 9)), F.asc("ts"), F.asc("uid")]
    return top_k(rows, [CAPTURE], order, k, rank="position")


def credential_evidence(packets: DataFrame, k: int = 20) -> DataFrame:
    rows = sample_rows(packets, "credentials").select(
        CAPTURE, "frame_no", "ts", "src", "dst", F.col("http_authorization").alias("auth_header")
    )
    return top_k(rows, [CAPTURE], [F.asc("frame_no")], k, rank="position")


def transfer_evidence(transfers: DataFrame, k: int = 10) -> DataFrame:
    return top_k(transfers, [CAPTURE], [F.asc("ts"), F.asc("uid")], k, rank="position")


def post_evidence(http: DataFrame, k: int = 20) -> DataFrame:
    columns = [
        c
        for c in ("ts", "uid", "orig_h", "resp_h", "resp_p", "uri", "host", "request_body_len")
        if c in http.columns
    ]
    rows = http.where("method = 'POST'").select(CAPTURE, *columns)
    return top_k(rows, [CAPTURE], [F.asc("ts"), F.asc("uid")], k, rank="position")


# Technique -> names of the evidence tables that belong to it.
EVIDENCE_TABLES = {
    "T1046": ("scan", "scan_timeline"),
    "T1021.002": ("smb_shares", "smb_paths", "smb_files"),
    "T1071.004": ("dns",),
    "T1040": ("credentials",),
    "T1048.003": ("transfers", "posts"),
}


def deep_dive(
    findings: DataFrame, tables: dict[str, DataFrame], threshold: float = DEEP_DIVE_THRESHOLD
) -> dict[str, DataFrame]:
    """Evidence tables kept for captures whose finding is strong enough, with the technique."""
    out = {}
    strong = findings.where(F.col("score") >= threshold)
    for ttp, names in EVIDENCE_TABLES.items():
        hit = strong.where(F.col("ttp_id") == ttp).select(CAPTURE, "ttp_id")
        for name in names:
            if name in tables:
                out[name] = tables[name].join(hit, CAPTURE)
    return out


TECHNIQUE = {name: ttp for ttp, names in EVIDENCE_TABLES.items() for name in names}


def of_strong(rows: DataFrame, findings: DataFrame, threshold: float = DEEP_DIVE_THRESHOLD) -> DataFrame:
    """Rows by capture and technique whose finding is strong enough.

    An inner join: a semi join would be pushed below a union of kinds and repeat the findings for each.
    """
    strong = findings.where(F.col("score") >= threshold).select(CAPTURE, "ttp_id").distinct()
    return rows.join(strong, [CAPTURE, "ttp_id"])


def evidence_summaries(tables: dict[str, DataFrame], signals: DataFrame) -> DataFrame:
    """One summary line per capture and technique with evidence; of_strong keeps those of strong findings."""
    kinds = [k for k in SUMMARY_KINDS if k in tables]
    if not kinds:
        return signals.sparkSession.createDataFrame([], "capture_id string, ttp_id string, summary string")
    parts = []
    for kind in kinds:
        if kind == "scan":
            rows = tables[kind].select(CAPTURE, _scan_text().alias("text"), F.lit(1).cast("bigint").alias("n"))
        else:
            rows = tables[kind].groupBy(CAPTURE).agg(
                F.max(F.lit(None).cast("string")).alias("text"), F.count("*").alias("n")
            )
        parts.append(rows.select(CAPTURE, F.lit(TECHNIQUE[kind]).alias("ttp_id"), F.lit(kind).alias("kind"), "text", "n"))
    rows = reduce(DataFrame.unionByName, parts).join(signals.select(CAPTURE, *SUMMARY_SIGNALS), CAPTURE)
    return rows.select(CAPTURE, "ttp_id", summary_text(F.col("kind"), F.col("text"), F.col("n")).alias("summary"))


# Kinds that have a summary line, one of each technique, and the signals such lines name.
SUMMARY_KINDS = ("scan", "smb_shares", "dns", "credentials", "transfers")
SUMMARY_SIGNALS = (
    "dns_max_subdomain_entropy", "dns_nxdomain_rate", "max_outbound_bytes", "http_plaintext_post_count",
)


def _scan_text() -> Column:
    return F.format_string(
        "%s contacted %d hosts on %d ports.", "scanner_ip", "unique_dst_hosts_count", "unique_dst_ports_count"
    )


def summary_text(kind: Column, text_of: Column, n: Column) -> Column:
    """The summary line of one kind with n rows, beside the signals it names; text_of is that of a scan."""
    return (
        F.when(kind == "scan", text_of)
        .when(kind == "smb_shares", F.format_string("%d administrative share events shown.", n))
        .when(kind == "dns", F.format_string(
            "%d high-entropy lookups shown. Maximum entropy %.2f, failure rate %.2f%%.",
            n, "dns_max_subdomain_entropy", F.col("dns_nxdomain_rate") * 100))
        .when(kind == "credentials", F.format_string("%d clear-text credential events shown.", n))
        .otherwise(F.format_string(
            "Largest upload %d bytes, %d POST requests.", "max_outbound_bytes", "http_plaintext_post_count"))
    )


def _lines() -> dict[str, Column]:
    """What one row of each evidence table says, as text."""
    return {
        "scan": F.format_string("%s: %d ports, %d hosts", "scanner_ip", "unique_dst_ports_count", "unique_dst_hosts_count"),
        "scan_timeline": F.format_string("%s %.3f", "event", "ts"),
        "smb_shares": F.col("path"),
        "smb_paths": F.format_string("%s (%d)", "path", "uses"),
        "smb_files": F.col("name"),
        "dns": F.col("query"),
        "credentials": F.format_string("%s -> %s", "src", "dst"),
        "transfers": F.format_string("%s -> %s: %d bytes", "orig_h", "resp_h", "orig_bytes"),
        "posts": F.col("uri"),
    }


def evidence_lines(tables: dict[str, DataFrame], about: bool = False) -> DataFrame | None:
    """All evidence in one table: capture, technique, kind, position, line; None if there is no table.

    of_strong keeps the lines of strong findings, with one join for all kinds. With ``about`` a last column holds
    what the summary of a scan says, so that summaries too can be taken from the lines.
    """
    events = {e: i for i, e in enumerate(TIMELINE, 1)}
    parts = []
    for kind, line in _lines().items():
        if kind not in tables:
            continue
        if kind == "scan_timeline" and "scan" in tables:
            continue
        position = F.col("position")
        if kind == "scan":
            position = F.lit(1)
        elif kind == "scan_timeline":
            position = F.lit(None).cast("int")
            for event, at in events.items():
                position = F.when(F.col("event") == event, at).otherwise(position)
        said = F.lit(None).cast("string") if kind != "scan" else _scan_text()
        rows = tables[kind].select(CAPTURE, *_line_columns(kind, position, line, said))
        if kind == "scan" and "scan_timeline" in tables:
            # The timeline is the scan's row taken apart, so both kinds come from one reading of the scans.
            shown = [F.struct(*_line_columns(kind, position, line, said))]
            for event, at in events.items():
                moment = F.format_string("%s %.3f", F.lit(event), event)
                shown.append(F.struct(*_line_columns("scan_timeline", F.lit(at), moment, F.lit(None).cast("string"))))
            rows = tables[kind].select(CAPTURE, F.inline(F.array(*shown)))
        parts.append(rows if about else rows.drop("about"))
    return reduce(DataFrame.unionByName, parts) if parts else None


def _line_columns(kind: str, position: Column, line: Column, about: Column) -> list[Column]:
    return [
        F.lit(TECHNIQUE[kind]).alias("ttp_id"), F.lit(kind).alias("kind"), position.cast("int").alias("position"),
        line.alias("line"), about.alias("about"),
    ]


def lines_by_finding(lines: DataFrame, k: int = 3) -> DataFrame:
    """The evidence of each capture and technique in one row: the first k lines of every kind, by kind and position,
    and, of lines with ``about``, kind, text and row count of its summary. The lines are read once for all of it."""
    shown = F.when(F.col("position") <= k, F.struct("kind", "position", "line"))
    columns = [F.array_sort(F.collect_list(shown)).alias("first")]
    summed = F.col("kind").isin(*SUMMARY_KINDS)
    if "about" in lines.columns:
        columns += [
            F.max(F.when(summed, F.col("kind"))).alias("summary_kind"),
            F.max("about").alias("summary_about"),
            F.count(F.when(summed, 1)).alias("summary_rows"),
        ]
    out = lines.groupBy(CAPTURE, "ttp_id").agg(*columns)
    preview = F.transform("first", lambda e: F.concat_ws(": ", e["kind"], e["line"]))
    return out.withColumn("evidence_preview", preview).drop("first")


def format_evidence(df: DataFrame) -> DataFrame:
    """Evidence for display: readable names and times, internal fields dropped, lists cut.

    A long list shows its first entries and ``<name>_more`` the number left out.
    """
    renames = {"orig_h": "src", "orig_p": "src_port", "resp_h": "dst", "resp_p": "dst_port"}
    out = df.drop("uid", "proto").withColumnsRenamed(renames)
    columns = []
    for name, kind in out.dtypes:
        value = F.col(name)
        if name == "ts" and kind == "double":
            columns.append(F.when(value > 1e9, text.epoch_text(value)).otherwise(value.cast("string")).alias(name))
        elif kind.startswith("array"):
            columns.append(F.slice(value, 1, ARRAY_PREVIEW).alias(name))
            columns.append(F.greatest(F.size(value) - ARRAY_PREVIEW, F.lit(0)).alias(f"{name}_more"))
        else:
            columns.append(value)
    return out.select(*columns)
