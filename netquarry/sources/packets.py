"""Packet fields exported as tab-separated text with a header line, or as parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.schemas import PACKET_FIELDS, PACKET_SCHEMA
from netquarry.sources.files import capture_from_path, read_or_none
from netquarry.sources.zeek import typed


def read_packets(spark: SparkSession, path: str, format: str = "tsv") -> DataFrame:
    """The packet-field table; filters and projections are ordinary DataFrame operations.

    Exports list several values of one field with commas, protocol chains with colons.
    """
    if format == "parquet":
        packets = read_or_none(lambda: spark.read.parquet(path))
        return spark.createDataFrame([], PACKET_SCHEMA) if packets is None else packets
    schema = ", ".join(f"`{f}` string" for f in PACKET_FIELDS)
    raw = read_or_none(
        lambda: spark.read.schema(schema)
        .option("sep", "\t")
        .option("header", True)
        .option("quote", "")
        .option("recursiveFileLookup", True)
        .csv(path)
    )
    if raw is None:
        return spark.createDataFrame([], PACKET_SCHEMA)
    columns = [capture_from_path().alias("capture_id")]
    for field, (name, kind) in PACKET_FIELDS.items():
        value = F.col(f"`{field}`")
        if kind == "array<string>":
            values = F.transform(F.split(value, "[:,]"), lambda v: F.lower(F.trim(v)))
            columns.append(F.filter(values, lambda v: v != "").alias(name))
        else:
            columns.append(typed(value, kind).alias(name))
    return raw.select(*columns)
