"""Steps that report tables share: hosts and shares are told from distinct values."""

import re

from pyspark.sql import functions as F

from netquarry.functions import text
from netquarry.operators import inventory, packets as packet_ops, signals as sig
from netquarry.plans import catalog

catalog.load()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def packet_rows(spark):
    data = [(c, f"10.0.0.{i % 5}, 8.8.8.{i % 3}" if i % 4 else None, f"1.2.3.{i % 7}", i) for i in range(60) for c in ("a", None)]
    return spark.createDataFrame(data, "capture_id string, ip_src string, ip_dst string, frame_no bigint").select(
        "*", F.array(F.lit("ip"), F.when(F.col("frame_no") % 2 == 0, "http").otherwise("dns")).alias("protocols"),
        F.lit(1).alias("frame_len"), F.col("frame_no").cast("double").alias("ts"),
        *[F.lit(None).cast("string").alias(c) for c in ("arp_src_ip", "arp_dst_ip", "ftp_command")],
        F.when(F.col("frame_no") % 9 == 0, "Basic").otherwise("").alias("http_authorization"),
        *[(F.col("frame_no") % 100 + 20).cast("int").alias(c) for c in ("tcp_dstport", "udp_dstport", "data_len", "arp_opcode")])


def test_hosts_drop_the_reduction_below(spark):
    packets = packet_rows(spark)
    hosts = inventory.hosts(packet_ops.packet_rollup(packets))
    assert "protocols" not in plan(hosts).split("LogicalRDD")[0].split("Relation")[0]
    pairs = packets.select("capture_id", "ip_src", "ip_dst").collect()
    want = {(r.capture_id, ip.strip()) for r in pairs for side in (r.ip_src, r.ip_dst) if side for ip in side.split(",")}
    assert {(r.capture_id, r.ip) for r in hosts.collect()} == want and hosts.count() == len(want)


def test_shares_are_tested_once_a_path(spark):
    data = [("a", r"\\S\admin$"), ("a", r"\\S\docs"), ("b", r"\\S\docs"), ("b", None), ("c", r"\\S\ipc$"), ("d", None), ("e", "c")]
    log = spark.createDataFrame(data * 3, "capture_id string, path string").withColumns(
        {"orig_h": F.lit("10.0.0.1"), "resp_h": F.lit("10.0.0.2"), "ts": F.lit(1.0)})
    out = sig.smb_signals(log)
    assert {r[0]: r.smb_admin_share_detected for r in out.collect()} == dict(a=True, b=False, c=True, d=False, e=False)
    names = spark.createDataFrame([(p,) for p in ("x$", "Admin$", "C$1", "IPC", "ipc$", "", None)], "p string")
    want = {p: bool(p and re.search(r"ADMIN\$|C\$|IPC\$", p.upper())) for p in ("x$", "Admin$", "C$1", "IPC", "ipc$", "", None)}
    assert {r.p: r.a for r in names.select("p", text.is_admin_share(F.col("p")).alias("a")).collect()} == want


def test_talkers_are_cut_before_their_captures_are_joined(spark):
    for name in ("top_talkers", "primary_victim"):
        lines = plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001")).split("\n")
        ranking = next(i for i, line in enumerate(lines) if "Window [" in line and "bytes_total" in line)
        depth = len(lines[ranking]) - len(lines[ranking].lstrip(" :+-"))
        below = []
        for line in lines[ranking + 1:]:
            if len(line) - len(line.lstrip(" :+-")) <= depth:
                break
            below.append(line)
        assert below and not any("Join" in line for line in below)
