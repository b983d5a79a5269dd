"""Capture inventory from packet fields: protocols, conversations, hosts, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.functions.net import first_value, ip_to_long, ip_values, is_internal, ttl_to_os
from netquarry.functions.text import name_suffixes
from netquarry.operators.common import CAPTURE, top_k
from netquarry.operators.packets import packet_facts, rolled, sample_rows
from netquarry.sources.rules import Allowlist


def protocol_histogram(packets: DataFrame) -> DataFrame:
    """Frames and bytes per protocol; ``frame`` counts every packet."""
    chain = F.coalesce("protocols", F.array().cast("array<string>"))
    names = F.array_distinct(F.concat(F.array(F.lit("frame")), chain))
    return (
        rolled(packets)
        .select(CAPTURE, "n", "bytes", F.explode(names).alias("protocol"))
        .groupBy(CAPTURE, "protocol")
        .agg(F.sum("n").alias("frames"), F.sum("bytes").alias("bytes"))
    )


def timed_conversations(packets: DataFrame) -> DataFrame:
    """IP conversations with absolute times, source being the sender of the first packet."""
    rows = rolled(packets)
    src, dst = first_value(F.col("ip_src")), first_value(F.col("ip_dst"))
    rows = rows.withColumns({"src": src, "dst": dst}).where("src IS NOT NULL AND dst IS NOT NULL")
    low = F.least("src", "dst")
    from_low = F.col("src") == low

    def low_sum(column: str):
        return F.sum(F.when(from_low, F.col(column)).otherwise(0))

    # The first sender is found by comparing two frame numbers: text in an aggregate
    # buffer would turn the hash aggregation into a sort of all packets.
    pairs = rows.groupBy(CAPTURE, low.alias("low"), F.greatest("src", "dst").alias("high")).agg(
        F.min(F.when(from_low, F.col("first_frame"))).alias("low_frame"),
        F.min(F.when(~from_low, F.col("first_frame"))).alias("high_frame"),
        F.sum("n").alias("frames_total"),
        F.sum("bytes").alias("bytes_total"),
        low_sum("n").alias("frames_low"),
        low_sum("bytes").alias("bytes_low"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
    )
    low_first = F.coalesce(F.col("low_frame") <= F.col("high_frame"), F.col("high_frame").isNull())
    frames = F.when(low_first, F.col("frames_low")).otherwise(F.expr("frames_total - frames_low"))
    volume = F.when(low_first, F.col("bytes_low")).otherwise(F.expr("bytes_total - bytes_low"))
    return pairs.select(
        CAPTURE,
        F.when(low_first, F.col("low")).otherwise(F.col("high")).alias("src"),
        F.when(low_first, F.col("high")).otherwise(F.col("low")).alias("dst"),
        frames.alias("frames_fwd"),
        volume.alias("bytes_fwd"),
        (F.col("frames_total") - frames).alias("frames_back"),
        (F.col("bytes_total") - volume).alias("bytes_back"),
        "frames_total",
        "bytes_total",
        "first_ts",
        "last_ts",
    )


def from_start(convs: DataFrame, packets: DataFrame) -> DataFrame:
    """Conversations with their begin since the start of the capture in place of absolute times."""
    starts = rolled(packets).groupBy(CAPTURE).agg(F.min("first_ts").alias("capture_start_ts"))
    times = {"first_ts": F.col("first_ts") - F.col("capture_start_ts"), "last_ts": F.col("last_ts") - F.col("first_ts")}
    names = {"first_ts": "rel_start", "last_ts": "duration_secs"}
    return convs.join(starts, CAPTURE).select(
        *[times[c].alias(names[c]) if c in times else F.col(c) for c in convs.columns]
    )


def conversations(packets: DataFrame) -> DataFrame:
    """IP conversations, source being the sender of the first packet."""
    return from_start(timed_conversations(packets), packets)


def classify_conversations(convs: DataFrame) -> DataFrame:
    """Adds the direction class; internal is a property of the address, so no join is needed."""
    src, dst = is_internal(F.col("src")), is_internal(F.col("dst"))
    return convs.withColumn(
        "direction",
        F.when(src & dst, "internal_to_internal")
        .when(src != dst, "internal_to_external")
        .otherwise("external"),
    )


def top_talkers(convs: DataFrame, k: int = 20) -> DataFrame:
    order = [F.desc("bytes_total"), F.asc("src"), F.asc("dst")]
    return top_k(convs, [CAPTURE], order, k, rank="position")


def hosts(packets: DataFrame) -> DataFrame:
    """Distinct dotted quads with their internal flag.

    Field texts are made distinct before they are taken apart, each field by itself: a distinct of one field
    needs no reduction below it, so over the packet reduction Spark drops that one.
    """
    sides = [packets.select(CAPTURE, F.col(side).alias("text")).distinct() for side in ("ip_src", "ip_dst")]
    return (
        sides[0].unionByName(sides[1]).distinct().select(CAPTURE, F.explode(ip_values(F.col("text"))).alias("ip"))
        .distinct()
        .withColumn("is_internal", is_internal(F.col("ip")))
    )


def mac_ip(packets: DataFrame) -> DataFrame:
    """Addresses seen behind each hardware address, with the frame of first sight.

    One row per pair: a gateway's hardware address stands for unboundedly many hosts.
    """
    return packet_facts(packets, "mac").select(CAPTURE, F.col("a").alias("mac"), F.col("b").alias("ip"), "first_frame")


def hostnames(packets: DataFrame) -> DataFrame:
    """Name of each address from the first answer that holds it."""
    return packet_facts(packets, "name").groupBy(CAPTURE, F.col("a").alias("ip")).agg(
        F.min_by("b", "first_frame").alias("hostname")
    )


def os_hints(packets: DataFrame) -> DataFrame:
    """Operating-system family from the first time-to-live of each source."""
    return (
        packet_facts(packets, "ttl")
        .groupBy(CAPTURE, F.col("a").alias("ip"))
        .agg(F.min_by(F.col("b").try_cast("int"), "first_frame").alias("ttl"))
        .select(CAPTURE, "ip", ttl_to_os(F.col("ttl")).alias("os_hint"))
    )


def odd_ports(packets: DataFrame, k: int = 20) -> DataFrame:
    """First samples of HTTP and DNS on unusual ports."""
    port = F.when(F.col("sample") == "http", F.col("tcp_dstport")).otherwise(F.col("udp_dstport"))
    rows = sample_rows(packets, "odd_port").select(
        CAPTURE, "frame_no", F.col("sample").alias("proto"), "src", "dst", port.alias("port")
    )
    return top_k(rows, [CAPTURE, "proto"], [F.asc("frame_no")], k)


def visibility(protocols: DataFrame) -> DataFrame:
    """Share of analyzable and of encrypted (TLS, QUIC) bytes, in percent."""
    total = F.coalesce(F.max(F.when(F.col("protocol") == "frame", F.col("bytes"))), F.lit(1))
    hidden = F.coalesce(
        F.sum(F.when(F.col("protocol").isin("tls", "quic"), F.col("bytes"))), F.lit(0)
    )
    share = F.round(F.least(F.try_divide(hidden * 100.0, total), F.lit(100.0)), 1)
    return protocols.groupBy(CAPTURE).agg(share.alias("encrypted_pct")).select(
        CAPTURE,
        F.round(100.0 - F.col("encrypted_pct"), 1).alias("visibility_pct"),
        "encrypted_pct",
    )


def protocols_present(protocols: DataFrame) -> DataFrame:
    """Sorted protocol names per capture; the set of names is that of the dissectors."""
    return protocols.where("frames > 0").groupBy(CAPTURE).agg(
        F.sort_array(F.collect_set("protocol")).alias("protocols_present")
    )


def captures(packets: DataFrame) -> DataFrame:
    """One row per capture: packets, flows, duration, times, host counts, visibility.

    The file size is that of a classic packet file: 24 bytes, and 16 more per packet.
    """
    totals = rolled(packets).groupBy(CAPTURE).agg(
        F.sum("n").alias("total_packets"),
        (F.sum("bytes") + 16 * F.sum("n") + 24).alias("file_size_bytes"),
        F.min("first_ts").alias("start_ts"),
        F.max("last_ts").alias("end_ts"),
    )
    flows = timed_conversations(packets).groupBy(CAPTURE).agg(
        F.count("*").alias("total_flows"), F.max("last_ts").alias("flow_end_ts")
    )
    counts = hosts(packets).groupBy(CAPTURE).agg(
        F.count("*").alias("host_count"),
        F.count(F.when(F.col("is_internal"), 1)).alias("internal_count"),
    )
    histogram = protocol_histogram(packets)
    out = totals
    for part in (flows, counts, visibility(histogram), protocols_present(histogram)):
        out = out.join(part, CAPTURE, "left")
    duration = F.col("flow_end_ts") - F.col("start_ts")
    out = out.withColumn("flow_end_ts", duration).withColumnRenamed("flow_end_ts", "duration_secs")
    return out.na.fill(
        {"total_flows": 0, "duration_secs": 0.0, "host_count": 0, "internal_count": 0}
    )


def calibrate(captures: DataFrame) -> DataFrame:
    """Thresholds fitted to the length, size and protocol mix of each capture."""
    seconds, inside, everyone = F.col("duration_secs"), F.col("internal_count"), F.col("host_count")

    def whole(c):
        return F.floor(c).cast("bigint")

    present = F.coalesce("protocols_present", F.array().cast("array<string>"))

    def absent(*names):
        return ~F.arrays_overlap(present, F.array(*[F.lit(n) for n in names]))

    return captures.select(
        CAPTURE,
        F.greatest(F.lit(5).cast("bigint"), whole(seconds / 300)).alias("beacon_min_connections"),
        F.least(seconds * 0.3, F.lit(3600.0)).alias("beacon_min_duration_secs"),
        F.greatest(F.lit(5).cast("bigint"), whole(inside * 0.3)).alias("lateral_new_internal_connections"),
        F.lit(20).cast("bigint").alias("scan_unique_dst_ports"),
        F.greatest(
            F.lit(10).cast("bigint"), whole(F.greatest(everyone, F.lit(1)) * 0.2)
        ).alias("scan_unique_dst_hosts"),
        F.greatest(
            F.lit(10_000_000).cast("bigint"), whole(F.col("file_size_bytes") * 0.05)
        ).alias("exfil_bytes_threshold"),
        absent("dns").alias("skip_dns_ttps"),
        absent("smb").alias("skip_smb_ttps"),
        absent("kerberos").alias("skip_kerberos_ttps"),
        absent("http").alias("skip_http_ttps"),
        absent("tls", "ssl").alias("skip_tls_ttps"),
        absent("icmp").alias("skip_icmp_ttps"),
    )


def cidr_semi_join(df: DataFrame, ip_col: str, nets: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose address lies in any of many networks (``left_anti`` for in none).

    Networks are matched by equality on (network, prefix length): every address looks up
    its own network at each prefix length in use, at most 33 of them, instead of
    comparing with every network.
    """
    lengths = nets.agg(F.collect_set("prefix_len")).scalar()
    found = (
        df.select(F.col(ip_col).alias("_ip"))
        .distinct()
        .withColumn("_n", ip_to_long(F.col("_ip")))
        .where("_n IS NOT NULL")
        .withColumn("lengths", lengths)
        .select("_ip", "_n", F.explode("lengths").alias("prefix_len"))
        .withColumn("lo", F.expr("shiftleft(shiftright(_n, 32 - prefix_len), 32 - prefix_len)"))
        .join(nets.select("lo", "prefix_len").distinct(), ["lo", "prefix_len"], "left_semi")
        .select(F.col("_ip").alias(ip_col))
        .distinct()
    )
    return df.join(found, ip_col, how)


def mark_allowed(names: DataFrame, allow: Allowlist, kind: str = "ip") -> DataFrame:
    """Adds ``allowed`` to a table of addresses (column ip) or domains (column domain)."""
    if kind == "ip":
        known = cidr_semi_join(names.select("ip").distinct(), "ip", allow.nets)
    else:
        clean = F.regexp_replace(F.lower("domain"), r"\.+$", "")
        known = (
            names.select("domain")
            .distinct()
            .select("domain", F.explode(name_suffixes(clean)).alias("suffix"))
            .join(allow.domains.withColumnRenamed("domain", "suffix"), "suffix", "left_semi")
            .select("domain")
            .distinct()
        )
    return names.join(known.withColumn("_hit", F.lit(True)), kind, "left").select(
        *names.columns, F.coalesce("_hit", F.lit(False)).alias("allowed")
    )
