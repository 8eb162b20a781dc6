"""Runs of consecutive rows. Runs follow row order, not the calendar, and never leave their partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_position(days: DataFrame, value: Column, keys: list[str], order: str, name: str) -> DataFrame:
    """Position of each row within its run of equal values, starting at 1.

    All windows share one sort: the row number, and the row number at which the current run began.
    """
    rows = Window.partitionBy(*keys).orderBy(order)
    so_far = rows.rowsBetween(Window.unboundedPreceding, 0)
    starts = ~value.eqNullSafe(F.lag(value).over(rows)) | (F.col("__row") == 1)
    return (
        days.withColumn("__row", F.row_number().over(rows))
        .withColumn("__start", F.when(starts, F.col("__row")))
        .withColumn(name, F.col("__row") - F.max("__start").over(so_far) + 1)
        .drop("__row", "__start")
    )


def longest_spells(clean: DataFrame) -> DataFrame:
    """Longest dry and wet run per station and year; NULL for a year without a run of that kind."""
    runs = run_position(clean, F.col("Regentag"), ["station_id", "Jahr"], "Date", "run_length")
    return runs.groupBy("station_id", "Jahr").agg(
        F.max(F.when(F.col("Regentag") == 0, F.col("run_length"))).alias("Maximale_Trockenperiode"),
        F.max(F.when(F.col("Regentag") == 1, F.col("run_length"))).alias("Maximale_Regenperiode"),
    )


def warm_cold_class(days: DataFrame) -> DataFrame:
    """``Zu warm`` above the normal of the day, ``Zu kalt`` below it, NULL where equal or unknown."""
    return days.withColumn(
        "Abweichung",
        F.when(F.col("TMK") > F.col("Average_TMK"), "Zu warm").when(F.col("TMK") < F.col("Average_TMK"), "Zu kalt"),
    )


def warm_cold_segments(days: DataFrame) -> DataFrame:
    """Contiguous warm and cold stretches of each station-year: class, first and last day, rows."""
    keys = ["station_id", "Jahr"]
    classed = warm_cold_class(days.select(*keys, "Date", "TMK", "Average_TMK"))
    runs = run_position(classed, F.col("Abweichung"), keys, "Date", "__position")
    # Row number minus position is constant within a run.
    rows = Window.partitionBy(*keys).orderBy("Date")
    return (
        runs.withColumn("__run", F.row_number().over(rows) - F.col("__position"))
        .filter(F.col("Abweichung").isNotNull())
        .groupBy(*keys, "__run", "Abweichung")
        .agg(F.min("Date").alias("first_day"), F.max("Date").alias("last_day"), F.count(F.lit(1)).alias("n_days"))
        .drop("__run")
    )
