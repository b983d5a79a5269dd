"""Indicators: collection, enrichment from snapshots, fingerprint matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions.lists import BAD_JA3, BAD_JA3S, SAFE_DOMAINS
from netquarry.functions.net import is_external, is_internal
from netquarry.functions.text import domain_in, domains_in_text
from netquarry.operators.common import CAPTURE, top_k
from netquarry.session import local_table

MALICIOUS_ENGINES = 3
FEED_CONFIDENCE = 75


def ioc_ips(
    talkers: DataFrame | None = None,
    scans: DataFrame | None = None,
    transfers: DataFrame | None = None,
    posts: DataFrame | None = None,
    tls_ips: DataFrame | None = None,
    confirmed: DataFrame | None = None,
    alerts: DataFrame | None = None,
    talker_limit: int = 15,
) -> DataFrame:
    """Addresses worth reporting with the reasons; one row per capture and address.

    talkers has a position column, scans and talkers name src, tables of addresses name ip.
    """
    parts = []

    def add(df: DataFrame | None, ip: Column, keep: Column, reason: str) -> None:
        if df is not None:
            rows = df.where(keep & ip.isNotNull() & (ip != ""))
            parts.append(rows.select(CAPTURE, ip.alias("ip"), F.lit(reason).alias("reason")))

    dst, src, ip, resp = F.col("dst"), F.col("src"), F.col("ip"), F.col("resp_h")
    add(talkers, dst, (F.col("position") <= talker_limit) & is_external(dst), "top_talker")
    add(scans, src, ~is_internal(src), "scanner")
    add(transfers, resp, is_external(resp), "large_transfer")
    add(posts, ip, is_external(ip), "post_destination")
    add(tls_ips, ip, is_external(ip), "certificate_anomaly")
    add(confirmed, ip, F.lit(True), "confirmed_malicious")
    if alerts is not None:
        out_src, out_dst = F.col("src_ip"), F.col("dst_ip")
        add(alerts, out_dst, is_internal(out_src) & ~is_internal(out_dst), "alert_destination")
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows.groupBy(CAPTURE, "ip").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))


def ioc_domains(parents: DataFrame | None = None, alerts: DataFrame | None = None) -> DataFrame:
    """Parents with more than 10 names and domains named by alerts, minus the safe list.

    ``parents`` is the top list of a capture (see signals.top_parents).
    """
    parts = []
    if parents is not None:
        many = parents.where("fqdn_count > 10")
        parts.append(many.select(CAPTURE, F.lower("parent").alias("domain")))
    if alerts is not None:
        parts.append(alerts.select(CAPTURE, F.explode(domains_in_text(F.col("signature"))).alias("domain")))
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows.where(~domain_in(F.col("domain"), SAFE_DOMAINS)).distinct()


def ioc_hashes(files: DataFrame) -> DataFrame:
    """Hashes of transferred files."""
    return files.where("sha256 IS NOT NULL AND sha256 NOT IN ('', 'nan', '-')").select(
        CAPTURE,
        "sha256",
        F.coalesce("mime_type", F.lit("unknown")).alias("mime_type"),
        F.coalesce("tx_hosts", F.lit("")).alias("source"),
        F.coalesce("extracted", F.lit("")).alias("filename"),
    )


def enrichment_targets(
    hosts: DataFrame,
    talkers: DataFrame,
    scan_targets: DataFrame | None = None,
    allowed: DataFrame | None = None,
    max_ips: int = 20,
) -> DataFrame:
    """Addresses to enrich: scan targets, then talkers, then other external hosts A-Z.

    Internal and allow-listed addresses are left out; the first reason of an address counts.
    """
    def tier(df: DataFrame, ip: Column, order: Column, rank: int, reason: str) -> DataFrame:
        return df.select(
            CAPTURE, ip.alias("ip"), F.lit(rank).alias("tier"), order.cast("bigint").alias("at"),
            F.lit(reason).alias("source"),
        )

    ends = talkers.select(CAPTURE, F.posexplode(F.array("src", "dst")).alias("side", "end"), "position")
    parts = [
        tier(ends, F.col("end"), F.col("position") * 2 + F.col("side"), 2, "top_talker"),
        tier(hosts.where("NOT is_internal"), F.col("ip"), F.lit(0), 3, "external_ip"),
    ]
    if scan_targets is not None:
        sample = scan_targets.select(CAPTURE, F.posexplode("unique_dst_hosts_sample").alias("at", "ip"))
        parts.append(tier(sample, F.col("ip"), F.col("at"), 1, "scan_target"))
    rows = reduce(lambda a, b: a.unionByName(b), parts).where(~is_internal(F.col("ip")))
    if allowed is not None:
        rows = rows.join(allowed.select("ip").distinct(), "ip", "left_anti")
    first = rows.groupBy(CAPTURE, "ip").agg(F.min(F.struct("tier", "at", "source")).alias("first"))
    order = [F.asc("first.tier"), F.asc("first.at"), F.asc("ip")]
    return top_k(first, [CAPTURE], order, max_ips, rank="position").select(
        CAPTURE, "position", "ip", "first.source"
    )


def best_feed_hit(feed: DataFrame) -> DataFrame:
    """Hit of the highest confidence per term, number of hits, and whether any has samples."""
    row = F.struct("confidence", "ioc", "threat_type", "malware", "first_seen", "tags")
    return feed.groupBy("term").agg(
        F.max_by(row, F.struct("confidence", "first_seen", "ioc")).alias("best"),
        F.count("*").alias("total_hits"),
        F.bool_or("has_samples").alias("has_samples"),
    ).select("term", "best.*", "total_hits", "has_samples")


def enrich(targets: DataFrame, reputation: DataFrame, feed: DataFrame) -> DataFrame:
    """Targets with reputation and feed answers, and the verdict."""
    known = reputation.select(
        "ip",
        F.col("malicious").alias("vt_malicious"),
        F.col("suspicious").alias("vt_suspicious"),
        F.col("reputation").alias("vt_reputation"),
        F.col("owner").alias("vt_owner"),
        F.col("country").alias("vt_country"),
    )
    hits = best_feed_hit(feed).select(
        F.col("term").alias("ip"),
        F.lit(True).alias("threatfox_found"),
        F.col("malware").alias("threatfox_malware"),
        F.col("threat_type").alias("threatfox_threat_type"),
        F.col("confidence").alias("threatfox_confidence"),
        F.col("tags").alias("threatfox_tags"),
    )
    joined = targets.join(known, "ip", "left").join(hits, "ip", "left").na.fill(
        {
            "vt_malicious": 0, "vt_suspicious": 0, "vt_reputation": 0, "vt_owner": "",
            "vt_country": "", "threatfox_found": False, "threatfox_malware": "",
            "threatfox_threat_type": "", "threatfox_confidence": 0,
        }
    )
    return joined.select(
        *targets.columns,
        *[c for c in known.columns if c != "ip"],
        *[c for c in hits.columns if c not in ("ip", "threatfox_tags")],
        F.coalesce("threatfox_tags", F.array().cast("array<string>")).alias("threatfox_tags"),
        confirmed_malicious().alias("is_confirmed_malicious"),
    )


def confirmed_malicious() -> Column:
    return (F.col("vt_malicious") >= MALICIOUS_ENGINES) | (F.col("threatfox_confidence") >= FEED_CONFIDENCE)


def bad_fingerprints(spark, table: dict[str, str], name: str) -> DataFrame:
    rows = [{name: h, f"{name}_family": f} for h, f in table.items()]
    return local_table(spark, rows, f"{name} string, {name}_family string")


def ja3_matches(
    ssl: DataFrame, bad_ja3: DataFrame | None = None, bad_ja3s: DataFrame | None = None
) -> DataFrame:
    """Sessions with a known-bad fingerprint, the first one per fingerprint pair.

    All sessions are looked at; those without a match are dropped before any shuffle when
    the fingerprint tables are small enough for Catalyst to broadcast them.
    """
    spark = ssl.sparkSession
    bad_ja3 = bad_fingerprints(spark, BAD_JA3, "ja3") if bad_ja3 is None else bad_ja3
    bad_ja3s = bad_fingerprints(spark, BAD_JA3S, "ja3s") if bad_ja3s is None else bad_ja3s
    known = (
        ssl.where("ja3 IS NOT NULL AND ja3 NOT IN ('', '-', 'nan')")
        .withColumn("ja3s", F.coalesce("ja3s", F.lit("")))
        .join(bad_ja3, "ja3", "left")
        .join(bad_ja3s, "ja3s", "left")
        .where("ja3_family IS NOT NULL OR ja3s_family IS NOT NULL")
    )
    session = F.struct("orig_h", "resp_h", "server_name")
    pairs = known.groupBy(CAPTURE, "ja3", "ja3s", "ja3_family", "ja3s_family").agg(
        F.min_by(session, F.struct("ts", "uid")).alias("s")
    )
    return pairs.select(
        CAPTURE, "ja3", "ja3s",
        F.col("ja3_family").isNotNull().alias("matched_bad_ja3"),
        F.col("ja3s_family").isNotNull().alias("matched_bad_ja3s"),
        F.coalesce("ja3_family", F.lit("")).alias("ja3_family"),
        F.coalesce("ja3s_family", F.lit("")).alias("ja3s_family"),
        F.coalesce("s.orig_h", F.lit("")).alias("src_ip"),
        F.coalesce("s.resp_h", F.lit("")).alias("dst_ip"),
        F.coalesce("s.server_name", F.lit("")).alias("server_name"),
    )
