"""Numeric expressions shared by beacon and rule scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def geomean(*cols: Column) -> Column:
    """Geometric mean, 0 when any part is not positive."""
    logs = reduce(lambda a, b: a + b, [F.ln(c) for c in cols])
    return F.when(F.least(*cols) <= 0, F.lit(0.0)).otherwise(F.exp(logs / len(cols)))


def compare(value: Column, op: Column, rhs: Column, rhs_is_bool: Column) -> Column:
    """value <op> rhs with the operator in a column; an unknown operator is false.

    A boolean right side compares the truth of the value.
    """
    left = F.when(rhs_is_bool, (value != 0).cast("double")).otherwise(value)
    return F.coalesce(
        F.when(op == ">=", left >= rhs)
        .when(op == "<=", left <= rhs)
        .when(op == ">", left > rhs)
        .when(op == "<", left < rhs)
        .when(op == "==", left == rhs)
        .when(op == "!=", left != rhs),
        F.lit(False),
    )
