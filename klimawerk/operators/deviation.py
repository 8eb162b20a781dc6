"""Deviation of one year, or of one of its months, from the normals of a reference period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klimawerk.functions.dates import period_bounds
from klimawerk.functions.measures import mean, nearest
from klimawerk.operators.normals import METRICS, year_metrics

TEMPERATURE = ["TMK", "TXK", "TNK", "Sommertag", "Hitzetag", "Frosttag", "Eistag", "Tropennacht"]
PRECIPITATION = ["RSK", "Regentag", "Schneetag"]
SUNSHINE = ["SDK", "Heiterertag", "Truebertag"]


def deviations(
    clean: DataFrame,
    year: int,
    period: str | tuple[int, int],
    month: int | None = None,
    metrics: list[str] | None = None,
) -> DataFrame:
    """Value, normal and rounded difference per station and metric; stations without rows in the slice are left out.

    The slice is one more year of the yearly aggregate, so value and normal come from one scan and need no join: the
    second level averages the years of the period and picks the selected one.
    """
    start, end = period_bounds(period)
    needed = clean.filter(f"Jahr = {int(year)} or Jahr between {start} and {end}")
    return deviations_of_years(year_metrics(needed, metrics or METRICS, month), year, period, metrics)


def deviations_of_years(per_year: DataFrame, year: int, period: str | tuple[int, int], metrics: list[str] | None = None) -> DataFrame:
    """The same from one row per station and year."""
    metrics = metrics or METRICS
    start, end = period_bounds(period)
    selected, reference = f"Jahr = {int(year)}", f"Jahr between {start} and {end}"
    both = (
        per_year.filter(f"{selected} or {reference}")
        .groupBy("station_id")
        .agg(
            F.expr(f"count_if({selected})").alias("n_selected"),
            *[F.expr(f"max(if({selected}, {m}, null))").alias(m) for m in metrics],
            *[mean(f"if({reference}, {m}, null)").alias(f"{m}_normal") for m in metrics],
        )
        .filter(F.col("n_selected") > 0)
    )
    return both.select(
        "station_id",
        *[c for m in metrics for c in (
            m, f"{m}_normal", nearest(f"{m} - {m}_normal").alias(f"{m}_diff")
        )],
    )
