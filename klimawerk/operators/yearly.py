"""Yearly rollup, and its variant with the longest dry and wet spell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from klimawerk.functions.dates import first_of_january
from klimawerk.functions.measures import mean, total
from klimawerk.operators.slices import select_days
from klimawerk.operators.spells import longest_spells
from klimawerk.schema import DAY_COUNTS


def yearly_aggregates() -> list[Column]:
    return [
        *[mean(c).alias(c) for c in ("TXK", "TMK", "TNK")],
        total("RSK").alias("RSK"),
        total("SDK").alias("SDK"),
        mean("NM").alias("NM"),
        *[F.sum(flag).alias(count) for flag, count in DAY_COUNTS.items()],
    ]


def yearly(clean: DataFrame, month: int | None = None) -> DataFrame:
    """One row per station and year, of the whole year or of one of its months."""
    return (
        select_days(clean, month=month)
        .groupBy("station_id", "Jahr")
        .agg(*yearly_aggregates())
        .withColumn("Day", first_of_january(F.col("Jahr")))
    )


def yearly_with_spells(clean: DataFrame, month: int | None = None) -> DataFrame:
    """The rollup with the longest run of dry and of rain rows.

    Only four narrow columns go through the exchange and sort that the runs need; the wide rollup is combined before
    its exchange. Both come out partitioned by station and year, so joining them moves no rows.
    """
    return yearly(clean, month).join(longest_spells(select_days(clean, month=month)), ["station_id", "Jahr"])
