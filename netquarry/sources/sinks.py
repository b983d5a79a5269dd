"""Result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_findings(findings: DataFrame, anomalies: DataFrame, path: str) -> dict[str, str]:
    """Findings and anomalies as JSON, one partition directory per capture."""
    targets = {"findings": f"{path}/findings", "anomalies": f"{path}/anomalies"}
    findings.write.mode("overwrite").partitionBy("capture_id").json(targets["findings"])
    anomalies.write.mode("overwrite").partitionBy("capture_id").json(targets["anomalies"])
    return targets
