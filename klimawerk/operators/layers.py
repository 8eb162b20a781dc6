"""Map layers: catalogue and conversion of raw readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from klimawerk.schema import MAP_LAYERS


def layer_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MAP_LAYERS, "layer string, alias string, unit string, needsConversion boolean")


def layer_values(readings: DataFrame) -> DataFrame:
    """Readings (``layer, raw``) with converted value and label.

    The catalogue is a fixed list of eight rows, so its broadcast cannot grow.
    """
    value = F.when(F.col("needsConversion"), F.col("raw") / 10).otherwise(F.col("raw"))
    return (
        readings.join(F.broadcast(layer_catalogue(readings.sparkSession)), "layer")
        .withColumn("value", value)
        .withColumn("label", F.when(F.col("value").isNotNull(), F.format_string("%s: %.1f %s", "alias", "value", "unit")))
    )
