"""Three reductions of the packet table; whoever reads packets reads one of them.

``packet_rollup`` sums packets by (capture, source, destination, protocol chain), ``packet_facts`` notes
when a pair of values was first seen, ``packet_samples`` keeps the first packets worth showing. An
analysis persists each once, so the packets are read three times whatever is asked of them. Operators
take packets or the reduction: functions here return a reduced table as it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions.net import first_value
from netquarry.operators.common import CAPTURE, count_if, top_k


def has_protocol(*names: str) -> Column:
    return reduce(lambda a, b: a | b, [F.array_contains("protocols", n) for n in names])


def packet_marks() -> dict[str, Column]:
    """Conditions on one packet, counted under these names in the reduction."""
    return {
        "n_gratuitous": (F.col("arp_opcode") == 1) & (F.col("arp_src_ip") == F.col("arp_dst_ip")),
        "n_large_icmp": has_protocol("icmp") & (F.col("data_len") > 512),
        "n_odd_http": has_protocol("http") & ~F.col("tcp_dstport").isin(80, 8080),
        "n_authorized": F.col("http_authorization") != "",
        "n_ftp_login": F.col("ftp_command").isin("USER", "PASS"),
    }


def packet_rollup(packets: DataFrame) -> DataFrame:
    """Packets reduced to one row per (capture, source, destination, protocol chain)."""
    return packets.groupBy(CAPTURE, "ip_src", "ip_dst", "protocols").agg(
        F.count("*").alias("n"),
        F.sum("frame_len").cast("bigint").alias("bytes"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.min("frame_no").alias("first_frame"),
        *[count_if(c).alias(n) for n, c in packet_marks().items()],
    )


def rolled(packets: DataFrame) -> DataFrame:
    """Packets, or their reduction, with the columns of the reduction."""
    if "n" in packets.columns:
        return packets
    return packets.select(
        CAPTURE, "ip_src", "ip_dst", "protocols",
        F.lit(1).cast("bigint").alias("n"),
        F.col("frame_len").cast("bigint").alias("bytes"),
        F.col("ts").alias("first_ts"),
        F.col("ts").alias("last_ts"),
        F.col("frame_no").alias("first_frame"),
        *[c.cast("bigint").alias(n) for n, c in packet_marks().items()],
    )


def _fact(kind: str, a: Column, b: Column, when: Column | None = None) -> Column:
    fact = F.struct(F.lit(kind).alias("fact"), a.alias("a"), b.alias("b"))
    return fact if when is None else F.when(when, fact)


def _facts_of_packet() -> dict[str, Column]:
    """Arrays of facts that one packet states; an entry without a or b states nothing."""
    sender = first_value(F.col("ip_src"))
    answer = F.col("dns_is_response") & (F.col("dns_qry_name") != "")
    name = F.regexp_replace("dns_qry_name", r"\.+$", "")
    answers = F.transform("dns_a", lambda ip: _fact("name", ip, name))
    return {
        "mac": F.array(_fact("mac", F.col("eth_src"), sender)),
        "ttl": F.array(_fact("ttl", sender, first_value(F.col("ip_ttl").cast("string")))),
        "arp": F.array(_fact("arp", F.col("arp_src_ip"), F.nullif("arp_src_mac", F.lit("")))),
        "replication": F.array(_fact("replication", sender, F.lit(""), has_protocol("drsuapi"))),
        "name": F.when(answer, answers),
    }


FACTS = ("mac", "ttl", "arp", "replication", "name")


def packet_facts(packets: DataFrame, *kinds: str) -> DataFrame:
    """One row per (capture, fact, a, b) with the frame of first sight, for some or all kinds.

    mac: hardware address and address; ttl: address and time-to-live; arp: address and the hardware
    address that claims it; replication: sender; name: address and the name it answers to. Texts are
    keys and the buffer is one number, so packets are hashed, not sorted, and combined before the shuffle.
    """
    kinds = kinds or FACTS
    if "fact" in packets.columns:
        return packets.where(F.col("fact").isin(*kinds))
    stated = _facts_of_packet()
    nothing = F.array().cast("array<struct<fact:string,a:string,b:string>>")
    facts = F.concat(*[F.coalesce(stated[k], nothing) for k in kinds])
    return (
        packets.select(CAPTURE, "frame_no", F.inline(facts))
        .where("a <> '' AND b IS NOT NULL")
        .groupBy(CAPTURE, "fact", "a", "b")
        .agg(F.min("frame_no").alias("first_frame"))
    )


def _samples_of_packet() -> dict[str, Column]:
    http = has_protocol("http") & ~F.col("tcp_dstport").isin(80, 8080, 443)
    # A packet has one transport; the port of the other one is absent and does not object.
    udp = F.coalesce(F.col("udp_dstport") != 53, F.lit(False))
    tcp = F.coalesce(F.col("tcp_dstport") != 53, F.lit(False))
    dns = has_protocol("dns") & (udp | tcp)
    return {
        "odd_port": F.when(http, "http").when(dns, "dns"),
        "credentials": F.when(F.col("http_authorization") != "", "credentials"),
    }


def sample_rows(packets: DataFrame, *topics: str) -> DataFrame:
    """Packets worth showing, once for each sample they belong to: http and dns (odd ports), credentials."""
    samples = {"odd_port": ("http", "dns"), "credentials": ("credentials",)}
    topics = topics or tuple(samples)
    if "sample" in packets.columns:
        return packets.where(F.col("sample").isin(*[s for t in topics for s in samples[t]]))
    found = [_samples_of_packet()[t] for t in topics]
    # Most packets belong to none; they go before any list is made.
    wanted = packets.where(reduce(lambda a, b: a | b, [f.isNotNull() for f in found]))
    return wanted.select(
        CAPTURE, "frame_no", "ts",
        (F.explode(F.array(*found)) if len(found) > 1 else found[0]).alias("sample"),
        F.col("ip_src").alias("src"), F.col("ip_dst").alias("dst"),
        "tcp_dstport", "udp_dstport", "http_authorization",
    ).where("sample IS NOT NULL")


def packet_samples(packets: DataFrame, k: int = 20) -> DataFrame:
    """The first k packets of each sample of a capture."""
    return top_k(sample_rows(packets), [CAPTURE, "sample"], [F.asc("frame_no")], k)
