"""Daily slices, their totals and whole-record averages, bounds and choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from klimawerk.functions.measures import mean, nearest, settled, total


def select_days(
    clean: DataFrame,
    station_id: str | None = None,
    year: int | None = None,
    month: int | None = None,
    years: tuple[int, int] | None = None,
) -> DataFrame:
    """Rows that meet all given conditions; ``years`` is inclusive on both ends."""
    if station_id is not None:
        clean = clean.filter(F.col("station_id") == station_id)
    if year is not None:
        clean = clean.filter(F.col("Jahr") == year)
    if years is not None:
        clean = clean.filter(F.col("Jahr").between(*years))
    if month is not None:
        clean = clean.filter(F.col("Monat") == month)
    return clean


def temperature_totals(days: DataFrame) -> DataFrame:
    """Means and threshold days of a daily slice, per station."""
    return days.groupBy("station_id").agg(
        mean("TNK").alias("TNK_avg"),
        mean("TMK").alias("TMK_avg"),
        mean("TXK").alias("TXK_avg"),
        F.expr("count_if(TXK >= 25)").alias("Sommertage"),
        F.expr("count_if(TXK >= 30)").alias("Hitzetage"),
        F.expr("count_if(TNK >= 20)").alias("Tropennaechte"),
        F.expr("count_if(TNK < 0)").alias("Frosttage"),
        F.expr("count_if(TXK < 0)").alias("Eistage"),
    )


def precipitation_totals(days: DataFrame) -> DataFrame:
    return days.groupBy("station_id").agg(
        total("RSK").alias("RSK_sum"),
        F.count_if(F.col("RSK") >= 0.1).alias("Regentage"),
        F.sum("Schneetag").alias("Schneetage"),
    )


def sun_totals(days: DataFrame) -> DataFrame:
    return days.groupBy("station_id").agg(
        total("SDK").alias("SDK_sum"),
        F.sum("Heiterertag").alias("Heiteretage"),
        F.sum("Truebertag").alias("Truebetage"),
    )


def temperature_record(yearly: DataFrame) -> DataFrame:
    """Averages over the yearly rows of a station."""
    counts = ["Sommertage", "Hitzetage", "Tropennaechte", "Frosttage", "Eistage"]
    return yearly.groupBy("station_id").agg(
        *[mean(c).alias(f"{c}_avg") for c in ("TNK", "TMK", "TXK")],
        *[nearest(settled(f"avg({c})")).alias(c) for c in counts],
    )


def precipitation_record(yearly: DataFrame) -> DataFrame:
    """As above, over years that have precipitation."""
    return _record(yearly.filter(nonzero("RSK")), {"RSK": "Avg_RSK_sum", "Regentage": "Avg_Regentage", "Schneetage": "Avg_Schneetage"})


def sun_record(yearly: DataFrame) -> DataFrame:
    """As above, over years that have sunshine, with their first and last year."""
    columns = {"SDK": "Avg_SDK_sum", "Heiteretage": "Avg_Heiteretage", "Truebetage": "Avg_Truebetage"}
    return _record(yearly.filter(nonzero("SDK")), columns)


def _record(yearly: DataFrame, columns: dict[str, str]) -> DataFrame:
    return yearly.groupBy("station_id").agg(
        F.min("Jahr").alias("first_year"),
        F.max("Jahr").alias("last_year"),
        *[mean(c).alias(name) for c, name in columns.items()],
    )


def nonzero(*columns: str) -> Column:
    """All columns present and not 0; removes years whose sum is 0 because nothing was measured."""
    condition = F.col(columns[0]) != 0
    for c in columns[1:]:
        condition = condition & (F.col(c) != 0)
    return condition


def bounds(clean: DataFrame) -> DataFrame:
    """First and last year, largest and smallest positive precipitation, per station."""
    return clean.groupBy("station_id").agg(
        F.min("Jahr").alias("first_year"),
        F.max("Jahr").alias("last_year"),
        F.max("RSK").alias("max_RSK"),
        F.min(F.when(F.col("RSK") > 0, F.col("RSK"))).alias("min_positive_RSK"),
    )


def available_months(clean: DataFrame) -> DataFrame:
    """Months a station has rows in."""
    return clean.select("station_id", "Monat", "Monat_german").distinct()


def sorted_output(table: DataFrame, *columns: str) -> DataFrame:
    """Sort a finished table, missing values last."""
    return table.orderBy(*[F.asc_nulls_last(c) for c in columns])
