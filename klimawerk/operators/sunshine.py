"""Possible sunshine and its overlay with the measured one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klimawerk.functions.dates import month_label
from klimawerk.functions.measures import nearest
from klimawerk.functions.solar import day_length
from klimawerk.schema import DEFAULT_LAT


def day_lengths(stations: DataFrame, year: int, month: int | None = None) -> DataFrame:
    """Day length for every station (``station_id, lat``) on every day of a year; rows are made inside the tasks."""
    days = F.sequence(F.make_date(F.lit(year), F.lit(1), F.lit(1)), F.make_date(F.lit(year), F.lit(12), F.lit(31)))
    series = (
        stations.select("station_id", "lat", F.explode(days).alias("date"))
        .withColumn("hours", day_length(F.col("lat"), F.col("date")))
        .withColumn("sunshine_duration", nearest("hours", 2))
        .drop("hours")
        .withColumn("Monat", F.month("date"))
        .withColumn("Monat_german", month_label(F.col("Monat")))
    )
    return series if month is None else series.filter(F.col("Monat") == month)


def sunshine_overlay(days: DataFrame, stations: DataFrame | None, year: int, month: int | None = None) -> DataFrame:
    """Possible sunshine of each day with the measured one beside it, for stations with measurements in the slice.

    Without a station dimension all stations get the default position; a station that the dimension lacks gets NULL.
    """
    measured = days.filter(F.col("SDK").isNotNull())
    located = measured.select("station_id").distinct()
    if stations is None:
        located = located.withColumn("lat", F.lit(DEFAULT_LAT))
    else:
        located = located.join(stations.select(F.col("number").alias("station_id"), "lat"), "station_id", "left")
    series = day_lengths(located, year, month).select("station_id", "date", "sunshine_duration")
    return series.join(measured.select("station_id", F.col("Date").alias("date"), "SDK"), ["station_id", "date"], "left")
