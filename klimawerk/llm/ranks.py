"""Places and running sums within a key that may hold any share of the rows: no key is ever brought into one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from klimawerk.llm.storage import written

SPAN = 1 << 12
"""Rows of a key whose running sum is taken in one group."""


def ranked(df: DataFrame, key: str, order: list, name: str) -> DataFrame:
    """``df`` with ``rank``, the place from 0 of each row among those of its key (a bigint, never null), written.

    Rows are sorted over all tasks by key and order, each task counts on from its own first row, and a task whose first key
    began in earlier ones adds what these hold. ``order`` should leave no ties but between equal rows.
    """
    ordered = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("part", F.spark_partition_id())
    at = df.columns.index(key)

    def count(batches):
        begin = last = None
        held = 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(at).to_numpy()
            begin = keys[0] if begin is None else begin
            new = np.concatenate([[keys[0] != last], keys[1:] != keys[:-1]])
            start = np.maximum.accumulate(np.where(new, np.arange(n), -held))
            rank = np.arange(n) - start
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rank), pa.array(keys == begin)], [*batch.schema.names, "rank", "opening"]
            )
            last, held = keys[-1], int(rank[-1]) + 1

    schema = ordered.schema.simpleString()[len("struct<"):-1]
    counted = written(ordered.mapInArrow(count, f"{schema},rank:bigint,opening:boolean"), name)
    # One row per task at most: the key that it opens with.
    openings = counted.where("opening").select(F.col(key).alias("__key")).distinct()
    spans = (
        counted.join(F.broadcast(openings), F.col(key) == F.col("__key"), "left_semi")
        .groupBy("part", key).agg(F.count("*").alias("n"), F.max("opening").alias("opening"))
    )
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where("opening and before > 0")
    spans = spans.select(F.col("part").alias("__part"), "before")
    return (
        counted.join(F.broadcast(spans), F.col("opening") & (F.col("part") == F.col("__part")), "left")
        .withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0).cast("bigint")))
        .drop("part", "opening", "__part", "before")
    )


def sums_before(df: DataFrame, key: str, at: str, values: dict[str, str], name: str) -> DataFrame:
    """``df`` with the sum of each value over the rows of its key at smaller places, named as ``values`` says.

    ``at`` are whole numbers, one row each and nearly gapless within a key; the sums of whole spans go ahead of those in a span.
    """
    spanned = written(df.withColumn("__span", F.floor(F.col(at) / SPAN)), name)
    totals = spanned.groupBy(key, "__span").agg(*[F.sum(v).alias(out) for v, out in values.items()])
    whole = Window.partitionBy(key).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select(
        F.col(key).alias("__key"), F.col("__span").alias("__span_at"),
        *[F.coalesce(F.sum(out).over(whole), F.lit(0)).alias(f"__ahead_{out}") for out in values.values()],
    )
    inside = Window.partitionBy(key, "__span").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    ahead = ahead.where("__span_at > 0")
    joined = spanned.join(ahead, (F.col(key) == F.col("__key")) & (F.col("__span") == F.col("__span_at")), "left")
    for v, out in values.items():
        joined = joined.withColumn(
            out, F.coalesce(F.sum(v).over(inside), F.lit(0).cast("bigint")) + F.coalesce(f"__ahead_{out}", F.lit(0).cast("bigint"))
        )
    return joined.drop("__span", "__key", "__span_at", *[f"__ahead_{out}" for out in values.values()])
