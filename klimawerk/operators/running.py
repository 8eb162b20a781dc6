"""Running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from klimawerk.operators.slices import nonzero


def running_total(
    table: DataFrame, columns: dict[str, str], keys: list[str], order: str, null_policy: str = "propagate"
) -> DataFrame:
    """Cumulative sums: input column -> output column.

    With ``propagate`` a NULL makes all later totals of its partition NULL, with ``skip`` it adds nothing.
    """
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    result = {}
    for column, name in columns.items():
        result[name] = F.round(F.sum(column).over(so_far), 9)
        if null_policy == "propagate":
            result[name] = F.when(~F.max(F.col(column).isNull()).over(so_far), result[name])
    return table.withColumns(result)


def precipitation_course(days: DataFrame, null_policy: str = "propagate") -> DataFrame:
    """Running precipitation and running normal through each station-year of a joined slice."""
    columns = {"RSK": "Cumulative_RSK", "Average_RSK": "Cumulative_avg_RSK"}
    return running_total(days, columns, ["station_id", "Jahr"], "Day", null_policy)


def sunshine_course(days: DataFrame) -> DataFrame:
    """Running sunshine over the days that have a value."""
    return running_total(days.filter(F.col("SDK").isNotNull()), {"SDK": "Cumulative_SDK"}, ["station_id", "Jahr"], "Day")


def yearly_precipitation_course(yearly: DataFrame) -> DataFrame:
    return running_total(yearly.filter(nonzero("RSK")), {"RSK": "Cumulative_RSK"}, ["station_id"], "Jahr")


def yearly_sunshine_course(yearly: DataFrame) -> DataFrame:
    return running_total(yearly.filter(F.col("SDK") > 0), {"SDK": "Cumulative_SDK"}, ["station_id"], "Jahr")
