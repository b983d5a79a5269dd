"""Helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.functions.net import is_external, is_internal

CAPTURE = "capture_id"


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None
) -> DataFrame:
    """First k rows per group. Spark limits each group before the shuffle (WindowGroupLimit)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("bigint")), F.lit(0).cast("bigint"))


def flag_if(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def internal_rows(df: DataFrame, col: str, hosts: DataFrame | None) -> DataFrame:
    """Rows whose address is internal.

    Without a host table the test is a pure function of the address and needs no join.
    """
    if hosts is None:
        return df.where(is_internal(F.col(col)))
    inside = hosts.where("is_internal").select(CAPTURE, F.col("ip").alias(col)).distinct()
    return df.join(inside, [CAPTURE, col], "left_semi")


def external_rows(df: DataFrame, col: str, hosts: DataFrame | None) -> DataFrame:
    """Rows whose address is a known external host."""
    if hosts is None:
        return df.where(is_external(F.col(col)))
    outside = hosts.where("NOT is_internal").select(CAPTURE, F.col("ip").alias(col)).distinct()
    return df.join(outside, [CAPTURE, col], "left_semi")


def not_internal_rows(df: DataFrame, col: str, hosts: DataFrame | None) -> DataFrame:
    """Rows whose address is not one of the internal hosts."""
    if hosts is None:
        return df.where(~is_internal(F.col(col)))
    inside = hosts.where("is_internal").select(CAPTURE, F.col("ip").alias(col)).distinct()
    return df.join(inside, [CAPTURE, col], "left_anti")
