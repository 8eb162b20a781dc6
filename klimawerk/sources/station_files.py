"""Daily station files: read many at once, write the same layout, export results."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from klimawerk.functions.dates import parse_day
from klimawerk.schema import STATION_FILE


def station_id_of(path: Column) -> Column:
    """Station number: all digits before ``.txt``, at least four, as text of at least four digits; NULL without one.

    ``<name>.txt`` may be a file or, when Spark wrote it, a folder of part files. Every row asks for it, so only those two names
    are searched for digits, not the whole path.
    """
    def number(name: Column) -> Column:
        digits = F.regexp_extract(name, r"(?<!\d)(\d{4,})\.txt$", 1)
        return F.when(name.endswith(".txt") & (digits != ""), F.format_string("%04d", digits.try_cast("bigint")))

    folder = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    return F.coalesce(number(folder), number(F.substring_index(path, "/", -1)))


REJECTED = "rejected_line"


def _reader(spark: SparkSession, schema: T.StructType) -> DataFrameReader:
    return (
        spark.read.schema(schema)
        .option("sep", ";")
        .option("header", True)
        .option("enforceSchema", False)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
    )


def _station() -> Column:
    return F.coalesce(station_id_of(F.col("_metadata.file_path")), F.format_string("%04d", F.col("STATIONS_ID")))


def read_station_files(spark: SparkSession, paths: str | list[str], overlapping: bool = False) -> DataFrame:
    """All matched station files as one DataFrame; a new station only needs a new file.

    The station number comes from the file name, or from the rows where the name has none.
    Names and order of the header are checked against the schema, so a file of another layout fails loudly. A value or row that
    can't be read becomes NULL here; ``land_station_files`` keeps such rows apart.
    With ``overlapping``, days that several files of a station repeat with equal values are kept once; days with different
    values stay, and cleaning fails on them.
    """
    days = _reader(spark, STATION_FILE).csv(paths).withColumn("station_id", _station()).drop("eor")
    return days.distinct() if overlapping else days


class TooManyRejected(ValueError):
    """More rows of some file were rejected than the loader allows."""


class Landed(NamedTuple):
    """Rows that could be read; rejected ones with file, reason and their text; rows and rejected rows per file."""

    days: DataFrame
    rejected: DataFrame
    files: DataFrame


def land_station_files(spark: SparkSession, paths: str | list[str], folder: str, max_share: float = 0.01) -> Landed:
    """Read station files whole, once, and keep the rows that can't be read in a quarantine table.

    A row is ``malformed`` if it has too few or too many fields or a value that is no number, and ``impossible_day`` if its date is
    none of the calendar. All rows are written below ``folder``, one sub-folder per outcome, before anything is decided, so
    the text is parsed with all its columns and only once. Loading fails if more than ``max_share`` of the rows of any file
    are rejected; the quarantine is kept for inspection then too.
    """
    parsed = _reader(spark, T.StructType([*STATION_FILE.fields, T.StructField(REJECTED, T.StringType())]))
    rows = parsed.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", REJECTED).csv(paths)
    line = F.concat_ws(";", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in STATION_FILE.names])
    reason = F.when(F.col(REJECTED).isNotNull(), "malformed").when(parse_day(F.col("MESS_DATUM")).isNull(), "impossible_day")
    rows = rows.withColumns({"station_id": _station(), "file": F.col("_metadata.file_path"), "reason": F.coalesce(reason, F.lit("ok"))})
    rows = rows.withColumn(REJECTED, F.when(F.col("reason") != "ok", F.coalesce(REJECTED, line))).drop("eor")
    rows.write.partitionBy("reason").parquet(folder)

    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "reason"], T.StructField("reason", T.StringType())])
    landed = spark.read.schema(schema).parquet(folder)
    name = F.regexp_replace("file", r"(\.txt)/[^/]*$", "$1")
    files = landed.groupBy(name.alias("file")).agg(
        F.min("station_id").alias("station_id"), F.count("*").alias("n_rows"), F.count_if(F.col("reason") != "ok").alias("n_rejected")
    )
    worst = files.where(F.col("n_rejected") > max_share * F.col("n_rows")).orderBy(F.desc(F.col("n_rejected") / F.col("n_rows")), "file").first()
    if worst is not None:
        raise TooManyRejected(f"{worst['n_rejected']} of {worst['n_rows']} rows of {worst['file']} are rejected, see {folder}")
    return Landed(
        landed.where("reason = 'ok'").drop(REJECTED, "file", "reason"),
        landed.where("reason != 'ok'").select("station_id", "file", "reason", REJECTED),
        files,
    )


def padded_columns(raw: DataFrame) -> list[Column]:
    """The columns of a station file as blank-padded text."""
    def padded(field: T.StructField) -> Column:
        width = max(len(field.name), 6)
        if field.name == "STATIONS_ID":
            value = F.col("station_id").cast("int").cast("string")
        elif field.name == "eor":
            return F.lit("eor").alias("eor")
        elif field.name in raw.columns:
            value = F.coalesce(F.col(field.name).cast("string"), F.lit(""))
        else:
            value = F.lit("-999")
        return F.when(F.length(value) < width, F.lpad(value, width, " ")).otherwise(value).alias(field.name)

    return [padded(f) for f in STATION_FILE.fields]


def write_station_files(raw: DataFrame, folder: str, dealt: bool = False) -> None:
    """Blank-padded station files, one ``..._<id>.txt`` folder per station below ``folder``, with gzipped parts.

    The rebalance splits a large station over several tasks and merges small ones; rows that are ``dealt`` by station already are
    written as they lie. They are sorted by file as numbers, a third as wide as their padded text.
    """
    name = F.format_string("produkt_klima_tag_%05d.txt", F.col("station_id").cast("int"))
    rows = raw if dealt else raw.hint("rebalance", "station_id")
    (
        rows.withColumn("file", name)
        .sortWithinPartitions("file")
        .select(*padded_columns(raw), "file")
        .write.partitionBy("file")
        .option("sep", ";")
        .option("header", True)
        .option("compression", "gzip")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("emptyValue", "")
        .csv(folder)
    )


def station_counts(daily: DataFrame) -> DataFrame:
    """Rows per station."""
    return daily.groupBy("station_id").agg(F.count(F.lit(1)).alias("n_rows"))


def loaded_counts(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows per station that cleaning keeps, beside the rows of its files; a station without a complete year has 0."""
    files = station_counts(raw).withColumnRenamed("n_rows", "n_file_rows")
    return files.join(station_counts(kept), "station_id", "left").select(
        "station_id", F.coalesce("n_rows", F.lit(0).cast("bigint")).alias("n_rows"), "n_file_rows"
    )


def loaded_total(kept: DataFrame) -> DataFrame:
    """One row: stations that are loaded, and their rows."""
    return station_counts(kept).agg(
        F.count(F.lit(1)).alias("n_stations"), F.coalesce(F.sum("n_rows"), F.lit(0).cast("bigint")).alias("n_rows")
    )


def union_stations(frames: Iterable[DataFrame]) -> DataFrame:
    """Frames of different stations or years as one, matched by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def export_table(table: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a whole result table as ``csv`` or ``parquet``."""
    if fmt == "csv":
        table.write.option("header", True).csv(path)
    elif fmt == "parquet":
        table.write.parquet(path)
    else:
        raise ValueError(f"unsupported export format: {fmt}")


def read_export(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    if fmt == "csv":
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.read.schema(schema).parquet(path)
