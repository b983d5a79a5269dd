"""Zeek JSON logs of many captures.

A root directory holds one directory per capture: ``<root>/<capture_id>/conn.log``, in one file or rotated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.schemas import ZEEK_LOGS, column_name, log_schema
from netquarry.sources.files import capture_from_path, read_or_none


def read_zeek_raw(spark: SparkSession, path: str, log: str, extra_fields=()) -> DataFrame:
    """A log with every field as text; absent fields are null.

    Reading all fields as text keeps rows whose values have another JSON type than
    expected. Only blank, comment and broken lines are dropped. Rotated files, such as
    ``conn.2024-05-01-10-00-00.log.gz``, belong to their log. ``extra_fields`` adds
    fields that log rules name and the standard schema lacks.
    """
    fields = list(ZEEK_LOGS[log])
    taken = {column_name(f).lower() for f in fields}
    for name in extra_fields:
        if column_name(name).lower() not in taken:
            fields.append(name)
            taken.add(column_name(name).lower())
    schema = ", ".join(f"`{f}` string" for f in fields)
    logs = read_or_none(
        lambda: spark.read.schema(schema)
        .option("mode", "DROPMALFORMED")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"{log}.{{log*,[0-9]*.log*}}")
        .json(path)
    )
    if logs is None:
        columns = ", ".join(f"`{column_name(f)}` string" for f in fields)
        return spark.createDataFrame([], f"capture_id string, {columns}")
    return logs.select(
        capture_from_path().alias("capture_id"),
        *[F.col(f"`{f}`").alias(column_name(f)) for f in fields],
    )


def typed(c: Column, kind: str) -> Column:
    """Text to a type; text that does not fit becomes null."""
    if kind == "string":
        return c
    if kind == "array<string>":
        # A JSON list, or one bare value.
        return F.coalesce(F.from_json(c, "array<string>"), F.when(c.isNotNull(), F.array(c)))
    if kind in ("int", "bigint"):
        return F.coalesce(c.try_cast(kind), c.try_cast("double").try_cast(kind))
    return c.try_cast(kind)


def read_zeek(spark: SparkSession, path: str, log: str) -> DataFrame:
    """A typed log table; a missing path or log is an empty table."""
    raw = read_zeek_raw(spark, path, log)
    return raw.select(
        "capture_id",
        *[
            typed(F.col(column_name(f)), kind).alias(column_name(f))
            for f, kind in ZEEK_LOGS[log].items()
        ],
    )


def read_logs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All known logs below a root."""
    return {log: read_zeek(spark, path, log) for log in ZEEK_LOGS}


def empty_log(spark: SparkSession, log: str) -> DataFrame:
    return spark.createDataFrame([], log_schema(log))


def available_logs(spark: SparkSession, root: str) -> DataFrame:
    """Sorted names of the log files present per capture; files without content are not listed."""
    files = read_or_none(
        lambda: spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.log")
        .load(root)
        .select("path")
    )
    if files is None:
        return spark.createDataFrame([], "capture_id string, logs array<string>")
    parts = F.split("path", "/")
    return (
        files.select(F.element_at(parts, -2).alias("capture_id"), F.element_at(parts, -1).alias("log"))
        .groupBy("capture_id")
        .agg(F.sort_array(F.collect_set("log")).alias("logs"))
    )
