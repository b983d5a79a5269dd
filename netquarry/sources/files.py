"""Path handling shared by the readers. All paths may lie on any file system Spark reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_or_none(read: Callable[[], DataFrame]) -> DataFrame | None:
    """The table, or None when the path does not exist."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def capture_from_path() -> Column:
    """Capture key of a file: the name of the directory it lies in."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)


def read_texts(spark: SparkSession, path: str, pattern: str) -> list[tuple[str, str]]:
    """(path, content) of small configuration files below a directory, sorted by path.

    Only for rule and allow-list files; their contents are needed on the driver to build plans.
    """
    files = read_or_none(
        lambda: spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )
    if files is None:
        return []
    return sorted((r["path"], r["value"]) for r in files.collect())


def load_yaml(text: str) -> list:
    """Documents of a YAML text."""
    try:
        import yaml
    except ImportError as error:
        raise ImportError("reading YAML rules needs the PyYAML package") from error
    return [doc for doc in yaml.safe_load_all(text) if doc is not None]
