"""Days per precipitation intensity class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klimawerk.functions.scales import precip_class, precip_scale


def intensity_classes(clean: DataFrame) -> DataFrame:
    """Days and mean scaled amount per station, year and class; the class of missing amounts is NULL."""
    return clean.groupBy("station_id", "Jahr", precip_class(F.col("RSK")).alias("class_from")).agg(
        F.count(F.lit(1)).alias("n_days"), F.round(F.avg(precip_scale(F.col("RSK"))), 9).alias("mean_scaled")
    )


def yearly_log_scale(yearly: DataFrame) -> DataFrame:
    """Yearly amounts on the logarithmic scale of the whole record, for years that have precipitation."""
    rows = yearly.filter(F.col("RSK") > 0)
    return rows.select("station_id", "Jahr", "RSK", F.round(F.log("RSK"), 9).alias("RSK_scaled"))
