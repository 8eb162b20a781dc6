"""Station dimension: lookup and joins.

Join sides carry no broadcast hint. Catalyst and AQE broadcast a dimension while its measured size is below the
threshold of the session, and use a shuffled join with skew splitting beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def find_station(stations: DataFrame, name: str, number: str) -> DataFrame:
    return stations.filter((F.col("name") == name) & (F.col("number") == number))


def with_station(daily: DataFrame, stations: DataFrame) -> DataFrame:
    """Daily rows with name, height and position of their station."""
    return daily.join(stations.withColumnRenamed("number", "station_id"), "station_id")


def stations_with_data(stations: DataFrame, daily: DataFrame) -> DataFrame:
    """Stations that have at least one daily row.

    The distinct ids are aggregated before the exchange, so the many rows of one station never meet in the join.
    """
    ids = daily.select(F.col("station_id").alias("number")).distinct()
    return stations.join(ids, "number", "left_semi")
