"""Patterns that stand out without a finding that explains them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.operators.common import CAPTURE, top_k
from netquarry.operators.scoring import DEEP_DIVE_THRESHOLD


def _percent(c: Column) -> Column:
    return F.concat(F.format_string("%.1f", c * 100), F.lit("%"))


def _rules(s) -> list[tuple]:
    """(type, condition, description, raw signals, why no finding) in fixed order."""

    def unexplained(ttp: str) -> Column:
        return ~F.array_contains("strong_ttps", ttp)

    return [
        (
            "dns_nxdomain_pattern",
            (s("dns_nxdomain_rate") >= 0.20) & unexplained("T1071.004"),
            F.concat(
                _percent(s("dns_nxdomain_rate")), F.lit(" of lookups fail, over "),
                s("dns_unique_query_count"),
                F.lit(" distinct names. Generated domains, rotating command servers or a broken client."),
            ),
            F.struct(
                "dns_nxdomain_rate", "dns_unique_query_count", "dns_avg_query_length",
                "dns_max_subdomain_entropy", "top_domains",
            ),
            "The failure rate is at least 20% and the tunneling rule stayed below its evidence level.",
        ),
        (
            "high_http_post_volume",
            (s("http_plaintext_post_count") >= 50) & unexplained("T1048.003"),
            F.concat(
                s("http_plaintext_post_count"),
                F.lit(" POST requests in clear text. Telemetry, uploads to a command server, or collected logins."),
            ),
            F.struct("http_plaintext_post_count", "http_packet_count", "max_outbound_bytes"),
            "Many POST requests, but no transfer large enough for the exfiltration rule.",
        ),
        (
            "broad_host_contact",
            (s("scan_max_unique_dst_hosts") >= 20) & unexplained("T1046"),
            F.concat(
                F.lit("One host contacted "), s("scan_max_unique_dst_hosts"),
                F.lit(" destinations. Automation, rotating command servers, or reconnaissance."),
            ),
            F.struct("scan_max_unique_dst_hosts", "scan_max_unique_dst_ports", "scan_candidates"),
            "Below the port-scan evidence level.",
        ),
        (
            "tls_missing_sni",
            s("tls_missing_sni_count") >= 5,
            F.concat(
                s("tls_missing_sni_count"),
                F.lit(" TLS sessions name no server. Browsers always do; custom clients often do not."),
            ),
            F.struct("tls_missing_sni_count", "tls_packet_count", "tls_unique_ja3_count"),
            "Client fingerprints are needed to tell known tooling apart.",
        ),
        (
            "arp_anomaly",
            (s("arp_gratuitous_count") >= 3) | (s("arp_ip_conflict_count") >= 1),
            F.concat(
                s("arp_gratuitous_count"), F.lit(" unsolicited ARP announcements and "),
                s("arp_ip_conflict_count"),
                F.lit(" addresses with several owners. Spoofing, or misconfigured equipment."),
            ),
            F.struct("arp_packet_count", "arp_gratuitous_count", "arp_ip_conflict_count"),
            "Below the poisoning evidence level; compare with the ARP tables of the network.",
        ),
        (
            "singleton_suspicious_domains",
            s("dns_singleton_suspicious_count") >= 1,
            F.concat(
                s("dns_singleton_suspicious_count"),
                F.lit(" suspicious name(s) looked up exactly once, for example "),
                F.array_join(F.slice("domains", 1, 5), ", "),
                F.lit(". Too rare for the volume rules."),
            ),
            F.struct(
                F.col("dns_singleton_suspicious_count").alias("singleton_suspicious_count"),
                "domains",
                F.col("dns_packet_count").alias("dns_total_queries"),
            ),
            "Each name occurs once, below every volume and entropy limit.",
        ),
    ]


def _list_of(df: DataFrame | None, value: Column, order: list[Column], k: int, name: str, kind: str):
    """At most k values per capture as an array; (table or None, array type)."""
    if df is None:
        return None, name, kind
    first = top_k(df, [CAPTURE], order, k, rank="_at")
    entries = F.array_sort(F.collect_list(F.struct("_at", value.alias("x"))))
    lists = first.groupBy(CAPTURE).agg(F.transform(entries, lambda e: e["x"]).alias(name))
    return lists, name, kind


def _techniques(findings: DataFrame) -> DataFrame:
    return findings.groupBy(CAPTURE).agg(
        F.array_sort(F.collect_set(F.when(F.col("score") >= DEEP_DIVE_THRESHOLD, F.col("ttp_id")))).alias("strong_ttps"),
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "ttp_id"))),
            lambda e: e["ttp_id"],
        ).alias("ttps_checked"),
    )


def anomalies(
    signals: DataFrame,
    findings: DataFrame | None = None,
    captures: DataFrame | None = None,
    parents: DataFrame | None = None,
    scans: DataFrame | None = None,
    singletons: DataFrame | None = None,
) -> DataFrame:
    """Six checks per capture, numbered in fixed order, each with a question for an analyst.

    Without ``findings``, ``signals`` has their techniques (scoring.assessed_captures).
    The optional tables (dns_parents, scan_sources candidates, dns_singletons) add examples.
    """
    base = signals if findings is None else signals.join(_techniques(findings), CAPTURE, "left")

    examples = [
        _list_of(parents, F.struct("parent", "fqdn_count"), [F.desc("fqdn_count"), F.asc("parent")], 5,
                 "top_domains", "array<struct<parent:string,fqdn_count:bigint>>"),
        _list_of(scans, F.struct("src", "unique_dst_ports", "unique_dst_hosts"),
                 [F.desc("unique_dst_ports"), F.desc("unique_dst_hosts"), F.asc("src")], 3,
                 "scan_candidates",
                 "array<struct<src:string,unique_dst_ports:bigint,unique_dst_hosts:bigint>>"),
        _list_of(singletons, F.col("query"), [F.asc("query")], 10, "domains", "array<string>"),
    ]
    for lists, name, kind in examples:
        empty = F.array().cast(kind)
        if lists is None:
            base = base.withColumn(name, empty)
        else:
            base = base.join(lists, CAPTURE, "left").withColumn(name, F.coalesce(name, empty))
    context = ("duration_secs", "total_flows", "internal_count", "visibility_pct")
    if captures is not None:
        base = base.join(captures.select(CAPTURE, *context), CAPTURE, "left")
    else:
        base = base.withColumns({c: F.lit(None).cast("double") for c in context})
    no_ids = F.array().cast("array<string>")
    base = base.withColumns(
        {c: F.coalesce(c, no_ids) for c in ("strong_ttps", "ttps_checked")}
    )
    found = [
        F.when(
            condition,
            F.struct(
                F.lit(kind).alias("anomaly_type"),
                description.alias("description"),
                F.to_json(raw).alias("raw_signals"),
                F.lit(reason).alias("reason_not_classified"),
            ),
        )
        for kind, condition, description, raw, reason in _rules(F.col)
    ]
    rows = base.select(
        CAPTURE, "ttps_checked", *context,
        F.posexplode(F.array_compact(F.array(*found))).alias("at", "a"),
    )
    out = rows.select(
        CAPTURE,
        F.format_string("ANO-%04d", F.col("at") + 1).alias("anomaly_id"),
        "a.*",
        "ttps_checked",
        *context,
    )
    return out.withColumn("prompt", hypothesis_prompt()).drop(*context)


def hypothesis_prompt() -> Column:
    """Question text about one anomaly, for an analyst or an assistant."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("unknown"))

    return F.concat(
        F.lit("Name the three most likely attack techniques or malware families behind this network "
              "anomaly, with reasons, and the packet evidence that would settle each.\n\nCapture: duration="),
        shown("duration_secs"), F.lit("s, flows="), shown("total_flows"),
        F.lit(", internal hosts="), shown("internal_count"),
        F.lit(", visibility="), shown("visibility_pct"),
        F.lit("%\n\nType: "), F.col("anomaly_type"),
        F.lit("\nDescription: "), F.col("description"),
        F.lit("\nSignals: "), F.col("raw_signals"),
        F.lit("\nFindings already considered: "), F.array_join("ttps_checked", ", "),
        F.lit("\nWhy it is no finding: "), F.col("reason_not_classified"),
    )
