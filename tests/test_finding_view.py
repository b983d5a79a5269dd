"""The finding view: evidence and signals are worked out once, with the same rows as before."""

import re

import pytest
from pyspark.sql import functions as F

from netquarry.operators import evidence, packets as packet_ops, report, sigma
from netquarry.plans import catalog

catalog.load()
from netquarry.plans.queries_rules import builtin_sigma  # noqa: E402

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def scans_of(df, table):
    executed = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(rf"FileScan parquet [^\n]*/{table}\.parquet", executed))


@pytest.mark.parametrize(("name", "most"), [("finding_view", 15)])
def test_lineitem_is_read_once_for_each_use(spark, name, most):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        assert 0 < scans_of(catalog.QUERIES[name](spark, SF), "lineitem") <= most  # 18 when signals and evidence came twice
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def tables(spark):
    scan = spark.createDataFrame(
        [("a", "10.0.0.1", 20, 12, 1.0, 9.5, 8.5), ("b", "10.0.0.2", 3, 40, None, 2.0, None), (None, "10.0.0.3", 1, 1, 0.0, 1.0, 1.0)],
        "capture_id string, scanner_ip string, unique_dst_ports_count bigint, unique_dst_hosts_count bigint, "
        "scan_start double, scan_end double, duration_secs double")
    listed = lambda data, columns: spark.createDataFrame(data, f"capture_id string, position int, {columns}")
    return {
        "scan": scan,
        "scan_timeline": evidence.scan_timeline(scan),
        "smb_shares": listed([("a", i, f"p{i}") for i in range(1, 6)] + [("a", 6, None)], "path string"),
        "smb_paths": listed([("a", 1, "p1", 5), ("c", 1, "p2", 1)], "path string, uses bigint"),
        "dns": listed([("b", 1, "x.example"), ("b", 2, None)], "query string"),
        "credentials": listed([("c", 1, "s", "d")], "src string, dst string"),
        "posts": listed([("a", 1, "/u"), ("b", 1, "/v")], "uri string"),
        "transfers": listed([("b", 1, "s", "d", 9)], "orig_h string, resp_h string, orig_bytes bigint"),
    }


def found(spark):
    signals = spark.createDataFrame(
        [("a", 3.25, 0.5, 7, 2), ("b", 1.0, 0.125, None, 0), ("c", None, 0.0, 5, 1)],
        "capture_id string, dns_max_subdomain_entropy double, dns_nxdomain_rate double, max_outbound_bytes bigint, "
        "http_plaintext_post_count bigint")
    techniques = F.explode(F.array(*[F.lit(t) for t in (*evidence.EVIDENCE_TABLES, "T9999")])).alias("ttp_id")
    findings = signals.select("capture_id", techniques, F.struct(*evidence.SUMMARY_SIGNALS).alias("_signals")).select(
        "*", F.lit("n").alias("name"), F.lit("c").alias("category"), F.lit("t").alias("mitre_tactic"),
        F.when(F.col("ttp_id") == "T1040", 0.4).otherwise(0.9).alias("score"), F.lit("LOW").alias("confidence"),
        F.array(F.lit("s_weak")).alias("signals_fired"), F.create_map(F.lit("k"), F.lit(1.0)).alias("raw_values"),
        F.lit("g").alias("fp_notes"))
    return signals, findings


@pytest.mark.parametrize("threshold", [0.6, 0.3])
def test_view_of_lines_equals_view_of_summaries(spark, threshold):
    signals, findings = found(spark)
    made = tables(spark)
    want = report.finding_view(
        findings.drop("_signals"), evidence.evidence_summaries(made, signals), evidence.evidence_lines(made), threshold=threshold)
    got = report.finding_view(findings, lines=evidence.evidence_lines(made, about=True), threshold=threshold)
    assert got.columns == want.columns and rows(got) == rows(want)
    summaries = {(r.capture_id, r.ttp_id): r.evidence_summary for r in got.collect()}
    assert summaries["a", "T1021.002"] == "6 administrative share events shown."
    assert summaries["c", "T1021.002"] is None and summaries["a", "T1048.003"] is None
    assert summaries["c", "T1040"] == (None if threshold > 0.4 else "1 clear-text credential events shown.")


def test_lines_of_the_scan_hold_its_timeline(spark):
    made = tables(spark)
    apart = [evidence.evidence_lines({k: made[k]}) for k in ("scan", "scan_timeline")]
    both = evidence.evidence_lines({k: made[k] for k in ("scan", "scan_timeline")})
    assert rows(both) == rows(apart[0].unionByName(apart[1])) and both.count() == 12


def packet_rows(spark):
    data = [(c, f"10.0.0.{i % 5}, 8.8.8.{i % 3}" if i % 4 else None, f"1.2.3.{i % 7}", i) for i in range(60) for c in ("a", None)]
    return spark.createDataFrame(data, "capture_id string, ip_src string, ip_dst string, frame_no bigint").select(
        "*", F.array(F.lit("ip"), F.when(F.col("frame_no") % 2 == 0, "http").otherwise("dns")).alias("protocols"),
        F.lit(1).alias("frame_len"), F.col("frame_no").cast("double").alias("ts"),
        *[F.lit(None).cast("string").alias(c) for c in ("arp_src_ip", "arp_dst_ip", "ftp_command")],
        F.when(F.col("frame_no") % 9 == 0, "Basic").otherwise("").alias("http_authorization"),
        *[(F.col("frame_no") % 100 + 20).cast("int").alias(c) for c in ("tcp_dstport", "udp_dstport", "data_len", "arp_opcode")])


def test_samples_without_lists(spark):
    packets = packet_rows(spark)
    assert "lambda" not in plan(packet_ops.sample_rows(packets, "credentials"))
    both = [(r.frame_no, r.sample) for r in packet_ops.sample_rows(packets).where("capture_id = 'a'").collect()]
    one = [r for t in ("odd_port", "credentials")
           for r in map(lambda r: (r.frame_no, r.sample), packet_ops.sample_rows(packets, t).where("capture_id = 'a'").collect())]
    assert sorted(both) == sorted(one) and {s for _, s in both} == {"http", "dns", "credentials"}


def test_log_rules_without_lists(spark):
    log = spark.createDataFrame([("a", r"\\S\admin$", 1.0)], "capture_id string, path string, ts double")
    assert "lambda" not in plan(sigma.scan_log(log, [r for r in builtin_sigma() if r.service == "smb_mapping"]).select("rule_id"))
