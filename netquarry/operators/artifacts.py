"""Certificates, file events over SMB, and extracted files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.functions.text import smb_path
from netquarry.operators.common import CAPTURE, top_k
from netquarry.sources.files import read_or_none

TEN_YEARS = 10 * 365 * 24 * 3600
DEFAULT_MIME = "application/octet-stream"


def certificates(
    x509: DataFrame, captures: DataFrame | None = None, known_bad: Iterable[str] = ()
) -> DataFrame:
    """Certificates with their anomalies, judged at capture time (``start_ts``).

    A null authority flag means no authority. Missing names are equal to each other.
    """
    rows = x509
    if captures is not None:
        rows = rows.join(captures.select(CAPTURE, "start_ts"), CAPTURE, "left")
    else:
        rows = rows.withColumn("start_ts", F.lit(0.0))
    subject = F.coalesce("certificate_subject", F.lit(""))
    issuer = F.coalesce("certificate_issuer", F.lit(""))
    is_ca = F.coalesce("basic_constraints_ca", F.lit(False))
    before = F.coalesce("certificate_not_valid_before", F.lit(0.0))
    after = F.coalesce("certificate_not_valid_after", F.lit(0.0))
    checked_at = F.when(F.col("start_ts") > 0, F.col("start_ts")).otherwise(before)
    bad = list(known_bad)
    flags = [
        F.when((subject == issuer) & ~is_ca, "self-signed"),
        F.when((after > 0) & (checked_at > 0) & (after < checked_at), "expired_at_capture_time"),
        F.when(~is_ca & (after - before > TEN_YEARS), "unusually_long_validity_leaf_cert"),
        F.when(F.trim(subject).rlike("^CN=[a-z]{6,14}$"), "generic_cn_looks_generated"),
    ]
    if bad:
        flags.append(F.when(F.col("fingerprint").isin(*bad), "known_malicious_cert"))
    no_names = F.array().cast("array<string>")
    return rows.select(
        CAPTURE,
        F.coalesce("fingerprint", F.lit("")).alias("fingerprint"),
        subject.alias("subject"),
        issuer.alias("issuer"),
        F.slice(F.coalesce("san_dns", no_names), 1, 10).alias("san_dns"),
        before.alias("not_valid_before"),
        after.alias("not_valid_after"),
        F.coalesce("certificate_key_type", F.lit("")).alias("key_type"),
        F.coalesce("certificate_key_length", F.lit(0)).alias("key_length"),
        is_ca.alias("is_ca"),
        F.array_compact(F.array(*flags)).alias("anomalies"),
    )


def suspicious_certificates(certs: DataFrame) -> DataFrame:
    return certs.where(F.size("anomalies") > 0)


def smb_events(smb_files: DataFrame) -> DataFrame:
    """File events with their full path."""
    return smb_files.select(
        CAPTURE,
        F.coalesce("ts", F.lit(0.0)).alias("ts"),
        F.coalesce("orig_h", F.lit("")).alias("src_ip"),
        F.coalesce("resp_h", F.lit("")).alias("dst_ip"),
        smb_path(F.col("path"), F.col("name")).alias("path"),
        F.upper(F.coalesce("action", F.lit(""))).alias("action"),
        F.coalesce("size", F.lit(0)).cast("bigint").alias("size_bytes"),
    )


def smb_writes(events: DataFrame) -> DataFrame:
    return events.where("action = 'WRITE'")


def mime_types(files: DataFrame) -> DataFrame:
    """Type per lower-cased file name; the last row wins."""
    return (
        files.where("filename <> ''")
        .groupBy(CAPTURE, F.lower("filename").alias("name_key"))
        .agg(F.max_by(F.coalesce("mime_type", F.lit(DEFAULT_MIME)), F.struct("ts", "fuid")).alias("mime_type"))
    )


def file_hashes(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """SHA-256, size and type of extracted files at ``<path>/<capture_id>/<protocol>/<name>``."""
    schema = (
        "capture_id string, protocol string, filename string, sha256 string, "
        "size_bytes bigint, mime_type string"
    )
    raw = read_or_none(
        lambda: spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    )
    if raw is None:
        return spark.createDataFrame([], schema)
    parts = F.split("path", "/")
    found = raw.select(
        F.element_at(parts, -3).alias(CAPTURE),
        F.upper(F.element_at(parts, -2)).alias("protocol"),
        F.element_at(parts, -1).alias("filename"),
        F.sha2("content", 256).alias("sha256"),
        F.col("length").alias("size_bytes"),
    )
    if files is None:
        return found.withColumn("mime_type", F.lit(DEFAULT_MIME))
    keyed = found.withColumn("name_key", F.lower("filename"))
    return (
        keyed.join(mime_types(files), [CAPTURE, "name_key"], "left")
        .withColumn("mime_type", F.coalesce("mime_type", F.lit(DEFAULT_MIME)))
        .drop("name_key")
    )


def duplicate_files(files: DataFrame, k: int = 15) -> DataFrame:
    """Files by hash: count, first name, type and size; most frequent first."""
    first = F.struct("filename", "mime_type", "size_bytes")
    groups = files.groupBy(CAPTURE, "sha256").agg(
        F.count("*").alias("file_count"), F.min(first).alias("first")
    )
    order = [F.desc("file_count"), F.asc("sha256")]
    return top_k(groups, [CAPTURE], order, k, rank="position").select(
        CAPTURE, "position", "sha256", "file_count", "first.*"
    )


def file_totals(files: DataFrame) -> DataFrame:
    return files.groupBy(CAPTURE).agg(
        F.count("*").alias("files"), F.count_distinct("sha256").alias("unique_hashes")
    )
