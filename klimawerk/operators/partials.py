"""Monthly sums, counts and flag counts per station, from which years, normals, deviations and tiles follow without daily rows.

A partial row adds up with any other, so a table of them is written once beside the cleaned days and merged to whatever slice is
asked for: about a thirtieth of the rows, and narrow. Daily values count to nine decimals, which is more than files have and what
filled gaps are settled to. Their sums are exact decimals, so the results are those of the daily rows however they were merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from klimawerk.functions.dates import first_of_january
from klimawerk.functions.measures import settled
from klimawerk.operators.normals import MEAN_METRICS
from klimawerk.operators.slices import select_days
from klimawerk.schema import DAY_COUNTS

SUMMED = ["TXK", "TMK", "TNK", "RSK", "SDK", "NM"]


def monthly_partials(clean: DataFrame) -> DataFrame:
    """(station_id, Jahr, Monat, n_days, sum and number of values per measurement, days per flag)."""
    return clean.groupBy("station_id", "Jahr", "Monat").agg(
        F.count("*").alias("n_days"),
        *[F.expr(f"cast(sum(cast({c} as decimal(18,9))) as decimal(28,9))").alias(f"{c}_sum") for c in SUMMED],
        *[F.count(c).alias(f"{c}_n") for c in SUMMED],
        *[F.expr(f"cast(sum({flag}) as bigint)").alias(flag) for flag in DAY_COUNTS],
    )


def _mean(c: str) -> Column:
    return F.expr(settled(f"cast(sum({c}_sum) as double) / nullif(sum({c}_n), 0)"))


def _total(c: str) -> Column:
    return F.expr(settled(f"coalesce(cast(sum({c}_sum) as double), 0D)"))


def year_metrics(partials: DataFrame, metrics: list[str], month: int | None = None, years: tuple[int, int] | None = None) -> DataFrame:
    """The first level of normals and deviations, as ``normals.year_metrics`` gives it from daily rows."""
    def metric(m: str) -> Column:
        if m in DAY_COUNTS:
            return F.expr(f"coalesce(cast(sum({m}) as double), 0D)")
        return _mean(m) if m in MEAN_METRICS else _total(m)

    return select_days(partials, month=month, years=years).groupBy("station_id", "Jahr").agg(*[metric(m).alias(m) for m in metrics])


def yearly(partials: DataFrame, month: int | None = None) -> DataFrame:
    """One row per station and year, as ``yearly.yearly`` gives it from daily rows."""
    return (
        select_days(partials, month=month)
        .groupBy("station_id", "Jahr")
        .agg(
            *[_mean(c).alias(c) for c in ("TXK", "TMK", "TNK")], _total("RSK").alias("RSK"), _total("SDK").alias("SDK"), _mean("NM").alias("NM"),
            *[F.sum(flag).alias(count) for flag, count in DAY_COUNTS.items()],
        )
        .withColumn("Day", first_of_january(F.col("Jahr")))
    )


def _days_of(flags: list[str]) -> list[Column]:
    return [F.sum(f).alias(DAY_COUNTS[f]) for f in flags]


def temperature_totals(partials: DataFrame) -> DataFrame:
    """Means and threshold days per station of the months that are given."""
    return partials.groupBy("station_id").agg(
        *[_mean(c).alias(f"{c}_avg") for c in ("TNK", "TMK", "TXK")],
        *_days_of(["Sommertag", "Hitzetag", "Tropennacht", "Frosttag", "Eistag"]),
    )


def precipitation_totals(partials: DataFrame) -> DataFrame:
    return partials.groupBy("station_id").agg(_total("RSK").alias("RSK_sum"), *_days_of(["Regentag", "Schneetag"]))


def sun_totals(partials: DataFrame) -> DataFrame:
    return partials.groupBy("station_id").agg(_total("SDK").alias("SDK_sum"), *_days_of(["Heiterertag", "Truebertag"]))
