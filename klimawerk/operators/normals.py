"""Climatological normals of a reference period and their joins to daily slices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from klimawerk.functions.dates import in_period, is_leap_day, period_bounds
from klimawerk.functions.measures import mean, settled, total
from klimawerk.operators.slices import select_days
from klimawerk.schema import NORMAL_DIVISOR, PERIODS

MEAN_METRICS = ["TMK", "TXK", "TNK"]
SUM_METRICS = [
    "RSK", "SDK", "Regentag", "Sommertag", "Hitzetag", "Tropennacht",
    "Frosttag", "Eistag", "Schneetag", "Heiterertag", "Truebertag",
]
METRICS = MEAN_METRICS + SUM_METRICS

ROWS_PER_TASK = 1 << 20
"""Result rows of a table of periods that one task makes."""


def metric_of_year(metric: str) -> Column:
    """First level: the mean or, for amounts and day counts, the sum of one year."""
    return (mean(metric) if metric in MEAN_METRICS else total(metric)).alias(metric)


def year_metrics(
    clean: DataFrame, metrics: list[str] = METRICS, month: int | None = None, years: tuple[int, int] | None = None
) -> DataFrame:
    """First level: one row per station and year. ``partials.year_metrics`` gives the same from monthly sums."""
    return select_days(clean, years=years, month=month).groupBy("station_id", "Jahr").agg(*[metric_of_year(m) for m in metrics])


def mean_over_time(
    clean: DataFrame, column: str, period: str | tuple[int, int], month: int | None = None, is_day: bool = False
) -> DataFrame:
    """Mean over the years of a period of the yearly means or, with ``is_day``, of the yearly sums."""
    per_year = total(column) if is_day else mean(column)
    return (
        select_days(clean, years=period_bounds(period), month=month)
        .groupBy("station_id", "Jahr")
        .agg(per_year.alias("per_year"))
        .groupBy("station_id")
        .agg(mean("per_year").alias("Average_column"))
    )


def normals(clean: DataFrame, period: str | tuple[int, int], month: int | None = None) -> DataFrame:
    """All fourteen normals of one period in one pass."""
    return (
        select_days(clean, years=period_bounds(period), month=month)
        .groupBy("station_id", "Jahr")
        .agg(*[metric_of_year(m) for m in METRICS])
        .groupBy("station_id")
        .agg(*[mean(m).alias(m) for m in METRICS])
    )


def normals_of_periods(
    clean: DataFrame, periods: list[str | tuple[int, int]] | None = None, month: int | None = None
) -> DataFrame:
    """All normals of several, also overlapping, periods in one pass.

    The yearly aggregate comes first; only its rows, one per station and year, are repeated for each period that
    contains them. A station without data in a period has no row for it.
    """
    bounds = [period_bounds(p) for p in periods or PERIODS]
    return periods_of_years(year_metrics(clean, month=month, years=(min(b[0] for b in bounds), max(b[1] for b in bounds))), periods)


def periods_of_years(per_year: DataFrame, periods: list[str | tuple[int, int]] | None = None) -> DataFrame:
    """Second level of ``normals_of_periods``."""
    bounds = [(f"{s}-{e}", s, e) for s, e in map(period_bounds, periods or PERIODS)]
    matching = F.array_compact(F.array(*[
        F.when(F.col("Jahr").between(start, end), F.lit(label)) for label, start, end in bounds
    ]))
    return (
        per_year.withColumn("Period", F.explode(matching))
        .groupBy("station_id", "Period")
        .agg(*[mean(m).alias(m) for m in METRICS])
    )


def normals_of_period_table(
    clean: DataFrame, periods: DataFrame, month: int | None = None, finish: Callable[[DataFrame], DataFrame] = lambda values: values
) -> DataFrame:
    """All normals of a table of periods (Period, first_year, last_year), of any number and overlap.

    Yearly values become running sums and counts per station, so a period is the difference of two years' rows, which both are
    found by equality: every station has a row for each year of the record as a whole. The work grows with the daily rows once and
    with the result, not with the years in the periods. Sums are exact decimals, so the result is that of summing each period.
    A station without data in a period has no row for it, and so has a period whose bounds are NULL or the wrong way round.

    ``finish`` is applied to the normals of each pair of bounds, before they are repeated for every period of these years.
    """
    return period_table_of_years(year_metrics(clean, month=month), periods, finish)


def period_table_of_years(
    yearly: DataFrame, periods: DataFrame, finish: Callable[[DataFrame], DataFrame] = lambda values: values
) -> DataFrame:
    """Second level of ``normals_of_period_table``."""
    span = yearly.agg(F.min("Jahr").alias("low"), F.max("Jahr").alias("high"), F.count_distinct("station_id").alias("stations")).first()
    low, high = (span["low"], span["high"]) if span["low"] is not None else (0, -1)
    counted = yearly.select(
        "station_id", "Jahr", F.lit(1).cast("bigint").alias("n"),
        *[F.col(m).cast("decimal(20,9)").alias(m) for m in METRICS], *[F.col(m).isNotNull().cast("bigint").alias(f"n_{m}") for m in METRICS],
    )
    # One row per station and year of the whole record, and one before it with empty sums.
    every = yearly.select("station_id").distinct().select("station_id", F.explode(F.sequence(F.lit(low - 1), F.lit(high))).alias("Jahr"))
    so_far = Window.partitionBy("station_id").orderBy("Jahr").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = ["n", *METRICS, *[f"n_{m}" for m in METRICS]]
    running = every.join(counted, ["station_id", "Jahr"], "left").select(
        "station_id", "Jahr", *[F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(c) for c in names]
    )
    inside = periods.select(
        "Period", F.greatest("first_year", F.lit(low)).alias("first_year"), F.least("last_year", F.lit(high)).alias("last_year")
    ).where("first_year <= last_year")
    end = running.select("station_id", F.col("Jahr").alias("last_year"), *[F.col(c).alias(f"end_{c}") for c in names])
    before = running.withColumn("first_year", F.col("Jahr") + 1).drop("Jahr")
    # Periods of the same years have the same normals, so these are made once for each pair of bounds and only then repeated by name.
    bounds = ["first_year", "last_year"]
    both = inside.select(*bounds).distinct().join(end, "last_year").join(before, ["station_id", "first_year"]).where(F.col("end_n") > F.col("n"))
    values = both.select("station_id", *bounds, *[
        F.expr(settled(f"CAST(end_{m} - {m} AS DOUBLE) / nullif(end_n_{m} - n_{m}, 0)")).alias(m) for m in METRICS
    ])
    # The result may be far larger than what is joined, so the number of tasks follows from its rows, not from the bytes that AQE sees.
    # Either side of the join may be the one that is broadcast, so both are dealt out.
    tasks = max(1, -(-inside.count() * span["stations"] // ROWS_PER_TASK))
    values = finish(values).repartition(tasks, "station_id", *bounds)
    return values.join(inside.repartition(tasks), bounds).select("station_id", "Period", *METRICS)


def daily_normals(clean: DataFrame, period: str | tuple[int, int], divisor: int = NORMAL_DIVISOR) -> DataFrame:
    """Normals per calendar day without 29 February.

    The precipitation normal divides by the nominal length of a period, not by the years that are present.
    """
    return (
        clean.filter(in_period(F.col("Jahr"), period) & ~is_leap_day(F.col("Monat"), F.col("Tag")))
        .groupBy("station_id", F.col("Monat").alias("Month"), F.col("Tag").alias("Day"))
        .agg(
            mean("TMK").alias("Average_TMK"),
            F.expr(settled(f"coalesce(sum(RSK), 0D) / {divisor}")).alias("Average_RSK"),
            total("SDK").alias("Average_SDK"),
        )
    )


def join_year_normals(days: DataFrame, day_normals: DataFrame) -> DataFrame:
    """Daily slice with the normals of the same month and day; NULL on 29 February.

    The key is the pair month and day rather than a date made of it: the aggregate is already partitioned by them.
    """
    keyed = day_normals.select(
        "station_id", F.col("Month").alias("Monat"), F.col("Day").alias("Tag"), "Average_TMK", "Average_RSK"
    )
    return days.join(keyed, ["station_id", "Monat", "Tag"], "left")


def join_month_normals(days: DataFrame, day_normals: DataFrame, year: int, month: int) -> DataFrame:
    """Daily slice of one month of one year with the normals set to dates of that year."""
    keyed = day_normals.filter(F.col("Month") == month).select(
        "station_id", F.make_date(F.lit(year), F.col("Month"), F.col("Day")).alias("Day"), "Average_TMK", "Average_RSK"
    )
    return days.join(keyed, ["station_id", "Day"], "left")
