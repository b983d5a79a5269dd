"""Signature alerts (EVE JSON lines) and externally computed beacon scores (CSV)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.functions.text import signature_to_technique
from netquarry.schemas import ALERT_SCHEMA, BEACON_CSV_SCHEMA
from netquarry.sources.files import capture_from_path, read_or_none

EVENT_SCHEMA = (
    "event_type string, timestamp string, src_ip string, src_port string, dest_ip string, "
    "dest_port string, proto string, alert struct<signature: string, signature_id: string, "
    "severity: string, category: string>"
)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Events of type alert with the defaults of missing fields: severity 3, ports 0."""
    events = read_or_none(
        lambda: spark.read.schema(EVENT_SCHEMA).option("recursiveFileLookup", True).json(path)
    )
    if events is None:
        return spark.createDataFrame([], ALERT_SCHEMA)

    def text(name: str):
        return F.coalesce(F.col(name), F.lit(""))

    def number(name: str, kind: str, default: int):
        return F.coalesce(F.col(name).try_cast(kind), F.lit(default).cast(kind))

    return events.where("event_type = 'alert'").select(
        capture_from_path().alias("capture_id"),
        text("timestamp").alias("timestamp"),
        text("src_ip").alias("src_ip"),
        number("src_port", "int", 0).alias("src_port"),
        text("dest_ip").alias("dst_ip"),
        number("dest_port", "int", 0).alias("dst_port"),
        text("proto").alias("proto"),
        text("alert.signature").alias("signature"),
        number("alert.signature_id", "bigint", 0).alias("signature_id"),
        number("alert.severity", "int", 3).alias("severity"),
        text("alert.category").alias("category"),
        signature_to_technique(text("alert.signature")).alias("technique"),
    )


# CSV header -> (column, type)
BEACON_HEADER = {
    "Score": ("score", "double"),
    "Source IP": ("src_ip", "string"),
    "Destination IP": ("dst_ip", "string"),
    "Connections": ("connections", "bigint"),
    "Avg. Bytes": ("avg_bytes", "double"),
    "Top Intvl": ("top_interval_secs", "double"),
    "Intvl Skew": ("interval_skew", "double"),
    "Size Skew": ("size_skew", "double"),
}


#: Columns of a file of beacon scores that are looked at.
WIDTH = 64


def read_beacon_csv(spark: SparkSession, path: str) -> DataFrame:
    """Beacon scores by header name; rows with a bad number are skipped.

    Every file has its own header, in any order: the line with a field "Score". A file without one, such as a
    text starting with "No results", gives no rows; an absent column reads as 0.
    """
    names = [f"c{i}" for i in range(WIDTH)]
    raw = read_or_none(
        lambda: spark.read.schema(", ".join(f"{n} string" for n in names)).option("recursiveFileLookup", True).csv(path)
    )
    if raw is None:
        return spark.createDataFrame([], BEACON_CSV_SCHEMA)
    lines = raw.select(
        F.col("_metadata.file_path").alias("file"), capture_from_path().alias("capture_id"), F.array(*names).alias("cells"))
    is_header = F.array_contains("cells", "Score")
    # One short row a file.
    headers = lines.where(is_header).groupBy("file").agg(F.min("cells").alias("header"))
    rows = lines.where(F.coalesce(~is_header, F.lit(True))).join(headers, "file")
    columns, valid = [F.col("capture_id")], F.lit(True)
    for header, (name, kind) in BEACON_HEADER.items():
        at = F.coalesce(F.array_position("header", header), F.lit(0)).cast("int") - 1
        value = F.when(at < 0, F.lit("0" if kind != "string" else "")).otherwise(F.get("cells", at))
        value = F.trim(value) if kind == "string" else value.try_cast(kind)
        columns.append(value.alias(name))
        if kind != "string":
            valid = valid & F.col(name).isNotNull()
    return rows.select(*columns).where(valid)
