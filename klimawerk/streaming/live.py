"""Live observations: the same functions serve a batch of landed payloads and a stream of them.

Landed rows are ``station_id string, payload string``, one JSON payload each.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from klimawerk.functions.dates import local_time_text
from klimawerk.functions.measures import mean
from klimawerk.functions.scales import band, compass_sector
from klimawerk.schema import BAND_RANGES, LIVE_PAYLOAD

LANDED = "station_id string, payload string"


def normalise(landed: DataFrame) -> DataFrame:
    """First observation of each payload in display units: degrees Celsius, km/h, missing rain as 0."""
    observation = F.get(F.from_json("payload", LIVE_PAYLOAD)["list"], F.lit(0))
    return landed.select("station_id", observation.alias("o")).select(
        "station_id",
        F.col("o.dt").alias("dt"),
        local_time_text(F.col("o.dt")).alias("local_time"),
        F.get("o.weather", F.lit(0))["description"].alias("description"),
        (F.col("o.main.temp") - 273.15).alias("temp"),
        F.col("o.main.pressure").alias("pressure"),
        F.col("o.main.humidity").alias("humidity"),
        (F.col("o.wind.speed") * 3.6).alias("wind_kmh"),
        F.col("o.wind.deg").alias("wind_deg"),
        F.coalesce("o.rain.1h", F.lit(0.0)).alias("rain"),
    )


def latest(observations: DataFrame) -> DataFrame:
    """Newest observation per station; equal times are settled by the remaining values, so the result is repeatable.

    The newest time per station is a hash aggregate; only rows of that time are ranked. A null time comes before all others.
    """
    newest = observations.groupBy("station_id").agg(F.max("dt").alias("newest")).withColumnRenamed("station_id", "station")
    same = observations["station_id"].eqNullSafe(newest["station"]) & observations["dt"].eqNullSafe(newest["newest"])
    rank = F.row_number().over(Window.partitionBy("station_id").orderBy(*[F.desc(c) for c in _values(observations)]))
    last = observations.join(newest, same, "left_semi").withColumn("rank", rank)
    return last.filter(F.col("rank") == 1).select("station_id", "dt", *_values(observations))


def _values(observations: DataFrame) -> list[str]:
    return [c for c in observations.columns if c not in ("station_id", "dt")]


def wind_rose(observations: DataFrame) -> DataFrame:
    """Observations per station and compass sector."""
    return observations.groupBy("station_id", compass_sector(F.col("wind_deg")).alias("sector")).agg(
        F.count(F.lit(1)).alias("n_observations"), mean("wind_kmh").alias("mean_wind_kmh")
    )


def with_bands(observations: DataFrame) -> DataFrame:
    """Third of its display range for temperature, pressure and humidity."""
    return observations.withColumns({
        f"{c}_band": band(F.col(c), low, high) for c, (low, high) in BAND_RANGES.items()
    })


def read_landed_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LANDED)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def without_redelivered(observations: DataFrame, within: str) -> DataFrame:
    """Each observation of a stream once, however often its payload arrives within that time of the newest one.

    The state holds the observations of that time only. An observation that comes later than that is dropped, as it can't be told
    from one seen before. Rows without a time are kept as they come.
    """
    timed = observations.filter(F.col("dt").isNotNull()).withColumn("observed_at", F.timestamp_seconds("dt"))
    once = timed.withWatermark("observed_at", within).dropDuplicatesWithinWatermark(observations.columns).drop("observed_at")
    return once.unionByName(observations.filter(F.col("dt").isNull()))


def write_normalised(stream: DataFrame, table: str, checkpoint: str, redelivered_within: str | None = None) -> StreamingQuery:
    """Append every observation to a Parquet table, each row exactly once, then stop when no input is left.

    Payloads that the source delivers again are rows of their own unless ``redelivered_within`` names a time.
    """
    observations = normalise(stream)
    if redelivered_within:
        observations = without_redelivered(observations, redelivered_within)
    return (
        observations
        .writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def write_latest(stream: DataFrame, table: str, checkpoint: str, compact_every: int = 10) -> StreamingQuery:
    """Keep the newest observation per station as a table of changes and a base.

    A batch writes only the stations that it changes, and a repeated batch overwrites its own rows. Every ``compact_every``
    batches the rows so far become a new base, and the changes and bases before it are emptied; the one base before is kept
    for readers that have begun. State holds one row per station.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{table}/changes/batch_id={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            read_latest(spark, table).write.mode("overwrite").parquet(f"{table}/base/batch_id={batch_id}")
            gone = [f"changes/batch_id={i}" for i in range(batch_id + 1 - compact_every, batch_id + 1)]
            if batch_id >= 2 * compact_every:
                gone.append(f"base/batch_id={batch_id - 2 * compact_every}")
            for folder in gone:
                batch.limit(0).write.mode("overwrite").parquet(f"{table}/{folder}")

    observations = normalise(stream)
    newest = observations.groupBy("station_id").agg(F.max(F.struct("dt", *_values(observations))).alias("newest"))
    return (
        newest.select("station_id", "newest.*")
        .writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_latest(spark: SparkSession, table: str) -> DataFrame:
    """Newest observation per station in base and changes; no rows before the first batch."""
    empty = normalise(spark.createDataFrame([], LANDED))
    parts = [empty]
    for part in ("base", "changes"):
        try:
            parts.append(spark.read.schema(empty.schema).parquet(f"{table}/{part}").select(*empty.columns))
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return latest(rows)
