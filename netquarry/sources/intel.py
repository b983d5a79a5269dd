"""Threat-intelligence snapshots: reputation answers and an indicator feed, as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.sources.files import read_or_none

STATS = "struct<malicious: bigint, suspicious: bigint, harmless: bigint, undetected: bigint>"
ATTRIBUTES = (
    f"last_analysis_stats: {STATS}, reputation: bigint, tags: array<string>, "
    "as_owner: string, country: string, registrar: string, categories: map<string,string>, "
    "meaningful_name: string, type_description: string"
)
ANSWER_SCHEMA = f"data struct<id: string, attributes: struct<{ATTRIBUTES}>>"

FEED_ITEM = (
    "struct<ioc: string, threat_type: string, malware: string, malware_printable: string, "
    "confidence_level: bigint, first_seen: string, tags: array<string>, "
    "malware_samples: array<string>>"
)
FEED_SCHEMA = (
    "term string, ioc string, threat_type string, malware string, confidence bigint, "
    "first_seen string, tags array<string>, has_samples boolean"
)


def _answers(spark: SparkSession, path: str, columns: list[tuple[str, Column]]) -> DataFrame:
    raw = read_or_none(
        lambda: spark.read.schema(ANSWER_SCHEMA).option("recursiveFileLookup", True).json(path)
    )
    if raw is None:
        raw = spark.createDataFrame([], ANSWER_SCHEMA)
    stats = "data.attributes.last_analysis_stats"
    return raw.where("data.id IS NOT NULL").select(
        *[c.alias(name) for name, c in columns],
        *[
            F.coalesce(F.col(f"{stats}.{s}"), F.lit(0).cast("bigint")).alias(s)
            for s in ("malicious", "suspicious", "harmless", "undetected")
        ],
        F.coalesce(F.col("data.attributes.reputation"), F.lit(0).cast("bigint")).alias("reputation"),
        F.coalesce(F.col("data.attributes.tags"), F.array().cast("array<string>")).alias("tags"),
    )


def _text(name: str) -> Column:
    return F.coalesce(F.col(f"data.attributes.{name}"), F.lit(""))


def read_ip_reputation(spark: SparkSession, path: str) -> DataFrame:
    return _answers(
        spark, path,
        [("ip", F.col("data.id")), ("owner", _text("as_owner")), ("country", _text("country"))],
    )


def read_domain_reputation(spark: SparkSession, path: str) -> DataFrame:
    categories = F.col("data.attributes.categories")
    return _answers(
        spark, path,
        [("domain", F.col("data.id")), ("registrar", _text("registrar")), ("categories", categories)],
    )


def read_hash_reputation(spark: SparkSession, path: str) -> DataFrame:
    return _answers(
        spark, path,
        [
            ("hash", F.col("data.id")),
            ("name", _text("meaningful_name")),
            ("type", _text("type_description")),
        ],
    )


def is_malicious(threshold: int = 3) -> Column:
    """Reputation rows with enough engines."""
    return F.col("malicious") >= threshold


def read_ioc_feed(spark: SparkSession, path: str) -> DataFrame:
    """Feed answers, one row per hit. ``data`` is a list of hits or a message; a message is no hit."""
    raw = read_or_none(
        lambda: spark.read.schema("search_term string, data string")
        .option("recursiveFileLookup", True)
        .json(path)
    )
    if raw is None:
        return spark.createDataFrame([], FEED_SCHEMA)
    hits = raw.select(
        "search_term", F.explode(F.from_json("data", f"array<{FEED_ITEM}>")).alias("hit")
    )
    samples = F.coalesce(F.size("hit.malware_samples") > 0, F.lit(False))
    return hits.where("hit IS NOT NULL").select(
        F.coalesce("search_term", "hit.ioc").alias("term"),
        F.coalesce("hit.ioc", F.lit("")).alias("ioc"),
        F.coalesce("hit.threat_type", F.lit("")).alias("threat_type"),
        F.coalesce("hit.malware_printable", "hit.malware", F.lit("")).alias("malware"),
        F.coalesce("hit.confidence_level", F.lit(0).cast("bigint")).alias("confidence"),
        F.coalesce("hit.first_seen", F.lit("")).alias("first_seen"),
        F.coalesce("hit.tags", F.array().cast("array<string>")).alias("tags"),
        samples.alias("has_samples"),
    )


def feed_by_hash(feed: DataFrame, value: str) -> DataFrame:
    return feed.where(F.col("ioc") == value)


def feed_by_tag(feed: DataFrame, tag: str) -> DataFrame:
    return feed.where(F.array_contains("tags", tag))
