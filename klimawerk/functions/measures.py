"""Expressions over measurements with the missing-value rules of the engine.

Three faces of missing data are kept apart: the sentinel (only before cleaning), NULL (after it) and NaN (never made).
Wide aggregates use these per column, so they take SQL text, which costs one call into the JVM instead of a dozen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from klimawerk.schema import SENTINEL, THRESHOLD_DAYS


def settled(result: str) -> str:
    """A sum or mean without the last-bit noise that the order of addition leaves, so that it does not depend on
    the partitioning and equal values compare as equal."""
    return f"round({result}, 9)"


def mean(value: str) -> Column:
    return F.expr(settled(f"avg({value})"))


def total(value: str) -> Column:
    """Sum in which a group without any value counts as 0."""
    return F.expr(settled(f"coalesce(sum({value}), 0D)"))


def measured(value: str) -> str:
    """The value, or NULL where it is the sentinel."""
    return f"nullif({value}, {SENTINEL}D)"


def sentinels(value: str) -> str:
    """Aggregate: how many values are the sentinel; NULL does not count."""
    return f"count_if({value} = {SENTINEL}D)"


def nearest(value: str, digits: int = 1) -> Column:
    """Rounded for display: the decimal neighbour nearer to the binary value, the even one at equal distance.

    From 2^53 steps on a double has no digits left to round, and ``floor`` would leave the range of a long.
    """
    scale = f"1e{digits}D"
    below, above = f"floor(({value}) * {scale})", f"ceil(({value}) * {scale})"
    down, up = f"(({value}) - {below} / {scale})", f"({above} / {scale} - ({value}))"
    rounded = f"if({down} < {up} or ({down} = {up} and {below} % 2 = 0), {below} / {scale}, {above} / {scale})"
    return F.expr(f"if(abs({value}) * {scale} >= {2.0**53!r}D, cast({value} as double), {rounded})")


def threshold_flags() -> dict[str, Column]:
    """The nine threshold-day flags by column name; a missing value gives 0."""
    return {name: F.expr(f"if({column} {op} {limit}D, 1, 0)") for name, column, op, limit in THRESHOLD_DAYS}
