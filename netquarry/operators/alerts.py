"""Statistics and duplicates of signature alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.operators.common import CAPTURE, count_if, top_k


def alert_stats(alerts: DataFrame) -> DataFrame:
    """Alert count, high-severity count and distinct techniques."""
    return alerts.groupBy(CAPTURE).agg(
        F.count("*").alias("alert_count"),
        count_if(F.col("severity") == 1).alias("high_severity_count"),
        F.array_sort(F.collect_set("technique")).alias("unique_techniques"),
    )


def duplicate_alerts(alerts: DataFrame, k: int = 15) -> DataFrame:
    """Alerts by (source, destination, signature): count and worst row, worst first."""
    row = F.struct("timestamp", "src_port", "dst_port", "technique", "category")
    groups = alerts.groupBy(CAPTURE, "src_ip", "dst_ip", "signature").agg(
        F.count("*").alias("alert_count"),
        F.min("severity").alias("severity"),
        F.min_by(row, F.struct("severity", "timestamp", "src_port", "dst_port", "technique")).alias("worst"),
    )
    order = [F.asc("severity"), F.desc("alert_count"), F.asc("src_ip"), F.asc("dst_ip"), F.asc("signature")]
    return top_k(groups, [CAPTURE], order, k, rank="position").select(
        CAPTURE, "position", "src_ip", "worst.src_port", "dst_ip", "worst.dst_port", "severity",
        "alert_count", "worst.technique", "signature",
    )
