"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from klimawerk.llm.text import BITMAP_BITS
from klimawerk.session import fresh_folder

_BLOCK = 4096


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back, so that later steps survive lost executors."""
    path = fresh_folder(df.sparkSession, f"llm-{name}")
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: str | Column) -> Column:
    """Tells rows of one id but different texts apart."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def without(docs: DataFrame, dropped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that are not in ``dropped(doc_id, text_key)``, with their own columns only."""
    gone = dropped.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    # Columns go by their table, so that no name of the documents can clash.
    same = docs[id_col].cast("bigint").eqNullSafe(gone["__id"]) & (text_key(docs[text_col]) == gone["__key"])
    return docs.join(gone, same, "left_anti")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slots_bitmap(rows: DataFrame, hash_: Column) -> np.ndarray:
    """One bit per slot of the hashes: two megabytes at any size, which is also all that the driver gets.

    Every task sets its own bits; blocks of them are united by block before they are put together.
    """
    size = 1 << (BITMAP_BITS - 3)

    def own(batches):
        bits = np.zeros(size, dtype=np.uint8)
        for batch in batches:
            at = np.unique(batch.column(0).to_numpy(zero_copy_only=False))
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield from _blocks({i: b for i, b in enumerate(bits.reshape(-1, _BLOCK)) if b.any()})

    def united(batches):
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                b = np.frombuffer(b, dtype=np.uint8)
                blocks[i] = blocks[i] | b if i in blocks else b
        yield from _blocks(blocks)

    slots = rows.select(F.shiftrightunsigned(hash_, 64 - BITMAP_BITS).cast("int").alias("slot"))
    parts = slots.mapInArrow(own, "block int, bits binary").repartition("block").mapInArrow(united, "block int, bits binary")
    bitmap = np.zeros((size // _BLOCK, _BLOCK), dtype=np.uint8)
    for r in parts.collect():  # one row per block
        bitmap[r["block"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return bitmap.reshape(-1)


def _blocks(blocks: dict[int, np.ndarray]):
    bits = pa.array([b.tobytes() for b in blocks.values()], pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), bits], ["block", "bits"])


def least_step(rows: DataFrame, step: Column, most: int) -> int:
    """Smallest whole-numbered step that at most ``most`` rows reach; a few hundred counts reach the driver."""
    counts = rows.groupBy(step.cast("int").alias("step")).agg(F.count("*").alias("n")).collect()
    least, total = (1 << 31) - 1, 0
    for at, n in sorted(((r["step"], r["n"]) for r in counts), reverse=True):
        if total + n > most:
            break
        least, total = at, total + n
    return least
