"""The cleaned daily table on disk: written once, queried many times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

STATION_GROUPS = 64


def write_clean(clean: DataFrame, path: str, replace: bool = False, dealt: bool = False) -> None:
    """Parquet with one folder per year, each file holding some groups of stations, sorted by station and day.

    Years are few and most queries ask for one year or a reference period, so folders prune whole files. A large year is dealt
    to files by groups of stations, so a station is in few of its files, and the sort lets row-group bounds skip the others.
    The rebalance merges small groups and splits large ones by size. Rows that are ``dealt`` by station already, as cleaning leaves
    them, lie in such groups as they are: each task writes one file a year of its stations. A table that exists is an error, unless
    ``replace`` asks for a new one in its place.
    """
    group = F.pmod(F.xxhash64("station_id"), F.lit(STATION_GROUPS))
    rows = clean if dealt else clean.withColumn("__group", group).hint("rebalance", "Jahr", "__group").drop("__group")
    (
        rows.sortWithinPartitions("Jahr", "station_id", "Date")
        .write.mode("overwrite" if replace else "errorifexists")
        .partitionBy("Jahr")
        .parquet(path)
    )


def read_clean(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """With a schema no job is needed to look it up; without one, extra columns of the source files are kept."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)
