"""Wide to long."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPERATURES = ["TNK", "TMK", "TXK"]


def temperatures_long(table: DataFrame, ids: list[str]) -> DataFrame:
    """One row per temperature; ``Cat_order`` sorts minimum, mean, maximum."""
    order = F.array_position(F.array(*[F.lit(c) for c in TEMPERATURES]), F.col("Cat")).cast("int")
    return table.unpivot(ids, TEMPERATURES, "Cat", "value").withColumn("Cat_order", order)
