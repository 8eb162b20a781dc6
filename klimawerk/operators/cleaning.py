"""From raw daily rows to the cleaned table: complete years, gap filling, threshold flags.

Two ways to the same rules. The reports (complete years, missing counts, day-of-year means) are hash aggregates with
map-side combine. ``clean`` needs the statistics beside every row and takes them as windows: one pass with one exchange,
by station, that serves the windows by station-year and by calendar day, where joining three aggregates back would read the
input four times. The key of the daily table bounds what meets in a task: a station has one row per day of its record. The
same pass checks the key, so rows that break the bound fail instead of doubling sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from klimawerk.functions.dates import month_label, parse_day, year_free_date
from klimawerk.functions.measures import mean, measured, sentinels, settled, threshold_flags
from klimawerk.schema import MAX_MISSING, MEASURES, MIN_MONTHS, SENTINEL

STATION_YEAR = ["station_id", "Jahr"]
CALENDAR_DAY = ["station_id", "Monat", "Tag"]

# Aggregate: the months seen, one bit each. A plain hash aggregate where a distinct count would expand the rows.
MONTH_SET = "bit_or(shiftleft(1, Monat))"


def add_date_parts(raw: DataFrame) -> DataFrame:
    """``MESS_DATUM`` to Date, Jahr, Monat, Tag; impossible days have NULL in all four."""
    return raw.withColumn("Date", parse_day(F.col("MESS_DATUM"))).withColumns({
        "Jahr": F.year("Date"),
        "Monat": F.month("Date"),
        "Tag": F.dayofmonth("Date"),
    })


def complete_years(days: DataFrame) -> DataFrame:
    """Station-years with rows in at least eleven months, whatever the rows hold."""
    return (
        days.groupBy(*STATION_YEAR)
        .agg(F.expr(f"bit_count({MONTH_SET})").alias("n_months"))
        .filter(F.col("n_months") >= MIN_MONTHS)
    )


def keep_complete_years(days: DataFrame) -> DataFrame:
    """Rows of complete station-years."""
    return days.join(complete_years(days), STATION_YEAR, "left_semi")


def missing_counts(days: DataFrame) -> DataFrame:
    """Sentinels per station-year and measurement."""
    return days.groupBy(*STATION_YEAR).agg(*[F.expr(sentinels(c)).alias(f"{c}_missing") for c in MEASURES])


def day_of_year_means(days: DataFrame) -> DataFrame:
    """Mean of the valid values per station, month and day."""
    return days.groupBy(*CALENDAR_DAY).agg(*[mean(measured(c)).alias(f"{c}_mean") for c in MEASURES])


def single_day() -> Column:
    """The date, or a failure where a station has two rows of one day."""
    before = F.lag("Date").over(Window.partitionBy(*STATION_YEAR).orderBy("Date"))
    message = F.concat(F.lit("two rows of station "), F.col("station_id"), F.lit(" on "), F.col("Date").cast("string"))
    return F.when(before == F.col("Date"), F.raise_error(message).cast("date")).otherwise(F.col("Date"))


def fill_gaps(days: DataFrame, dealt: bool = False) -> DataFrame:
    """Complete years only; sentinels replaced.

    A measurement with 60 or more sentinels in a year is NULL for that whole year. Other sentinels become the mean of
    the valid values of that calendar day over all complete years, also of those that are set to NULL. NULL stays.
    Two rows of one station and day are an error. Rows that are ``dealt`` to tasks by station already are not exchanged again.
    """
    year = f"over (partition by {', '.join(STATION_YEAR)})"
    calendar_day = f"over (partition by {', '.join(CALENDAR_DAY)})"
    # The exchange is stated, because the planner would place one for each window, after the inputs of the window functions,
    # which double the width of a row.
    known = days.filter(F.col("Date").isNotNull())
    counted = (
        (known if dealt else known.repartition("station_id"))
        .withColumn("Date", single_day())
        .withColumns({
            "n_months": F.expr(f"bit_count({MONTH_SET} {year})"),
            **{f"{c}_unusable": F.expr(f"{sentinels(c)} {year} >= {MAX_MISSING}") for c in MEASURES},
        })
        .filter(F.col("n_months") >= MIN_MONTHS)
        .drop("n_months")
    )
    filled = counted.withColumns({
        c: F.expr(
            f"case when {c}_unusable then null "
            f"when {c} = {SENTINEL}D then {settled(f'avg({measured(c)}) {calendar_day}')} else cast({c} as double) end"
        )
        for c in MEASURES
    })
    return filled.drop(*[f"{c}_unusable" for c in MEASURES])


def add_flags(days: DataFrame) -> DataFrame:
    """Calendar helper columns and the nine threshold-day flags."""
    return days.withColumns({
        "Day": F.col("Date"),
        "Date_without_year": year_free_date(F.col("Monat"), F.col("Tag")),
        "Monat_german": month_label(F.col("Monat")),
        **threshold_flags(),
    })


def clean(raw: DataFrame, dealt: bool = False) -> DataFrame:
    """Raw station rows to the cleaned daily table of all stations."""
    return add_flags(fill_gaps(add_date_parts(raw), dealt))
