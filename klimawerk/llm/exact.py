"""Exact deduplication by a persistent digest index, bucketed and sorted by digest.

New rows are digested and combined per digest, deduplicated against the index by a sort-merge anti-join, and what is new is
appended. Only DataFrame functions run. The folder is the index: any later application that names it goes on with it.

Defined results: a null text counts as empty, and all texts without a non-blank character are equal to each other. Of equal
texts the longest original (in code points) stays, then the smallest id; a null id comes last. A repeated row (same id and
text) is a copy like any other: it counts in ``group_size``, and of each group one row alone is marked kept. An empty table gives an empty result. Other columns of the input are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from klimawerk.llm.storage import written
from klimawerk.session import fresh_folder

BLANKS = r"[\x20\x09-\x0D]"
INDEX_SCHEMA = "digest string, keep_id bigint, keep_chars int, copies bigint"


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), BLANKS, "")


def digest(text: str | Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


MAX_FILES = 16
"""Files of a bucket, on average, beyond which an ingest rewrites the index."""


class DigestIndex:
    """One row per digest: the id and length of the row that stays and the copies that came with it.

    ``path`` holds generations, tables written by ``bucketBy(digest).sortBy(digest)``; the last complete one is the index.
    Opening registers its files and writes only where there is none; ``buckets`` is fixed when the index is made. ``compact``
    writes the rows as a new generation with one file per bucket and leaves the one before to its readers. One application
    at a time may ingest.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path = spark, path.rstrip("/")
        known = self._generations()
        self.generation, self.buckets = known[-1] if known else (0, buckets)
        if not known:
            self._write(spark.createDataFrame([], INDEX_SCHEMA))
        elif not spark.catalog.tableExists(self.name):
            location = self.location.replace("'", "\\'")
            spark.sql(
                f"CREATE TABLE {self.name} (digest string, keep_id bigint, keep_chars int, copies bigint) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{location}'"
            )

    @classmethod
    def temporary(cls, spark: SparkSession, buckets: int = 32) -> DigestIndex:
        return cls(spark, fresh_folder(spark, "llm-digests"), buckets)

    def _generations(self) -> list[tuple[int, int]]:
        """(number, buckets) of each complete generation, the current one last."""
        fs = self.spark._jvm.org.apache.hadoop.fs
        folder = fs.Path(self.path)
        files = folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not files.exists(folder):
            return []
        found = []
        for status in files.listStatus(folder):
            named = re.fullmatch(r"generation-(\d+)-of-(\d+)", status.getPath().getName())
            if named and files.exists(fs.Path(status.getPath(), "_SUCCESS")):
                found.append((int(named[1]), int(named[2])))
        return sorted(found)

    @property
    def location(self) -> str:
        return f"{self.path}/generation-{self.generation}-of-{self.buckets}"

    @property
    def name(self) -> str:
        """The catalog's name for the current generation, which follows from its place."""
        return f"llm_digests_{hashlib.sha256(self.location.encode()).hexdigest()[:32]}"

    def _write(self, rows: DataFrame) -> None:
        # Dealt by bucket, so that each gets one file, into however many partitions the rows go.
        (rows.repartition(self.buckets, F.pmod(F.hash("digest"), F.lit(self.buckets)))
         .write.bucketBy(self.buckets, "digest").sortBy("digest")
         .option("path", self.location).mode("append").format("parquet").saveAsTable(self.name))

    def _append(self, rows: DataFrame) -> None:
        self._write(rows)
        if len(self.rows().inputFiles()) > MAX_FILES * self.buckets:
            self.compact()

    def compact(self) -> None:
        rows = self.rows()
        self.close()
        self.generation += 1
        self._write(rows)

    def close(self) -> None:
        """Take the index out of the catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)  # another session may have appended
        return self.spark.table(self.name)

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
        """Add the new texts of ``docs``; one row for each of its rows, as ``exact_duplicates`` describes.

        A text that the index held before keeps the index's row, so none of the batch's copies stays. ``group_size`` counts
        the copies of this batch and those that came with the index's row. ``row`` is ``row_col`` or else a number of no meaning.
        """
        signed = written(
            docs.select(
                (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"),
                F.col(id_col).cast("bigint").alias("doc_id"),
                digest(text_col).alias("digest"),
                F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("chars"),
                F.xxhash64(text_col).alias("original"),
            ),
            "digests",
        )
        # The complement orders ids from large to small; a null id comes first, so it is chosen last. Rows of one id and length
        # are told apart by their text, and wholly equal ones by their number.
        order = F.struct("chars", F.bitwise_not("doc_id").alias("turned"), "original", "row")
        batch = (
            signed.groupBy("digest").agg(F.max(order).alias("best"), F.count("*").alias("copies"))
            .select(
                "digest", F.bitwise_not("best.turned").alias("keep_id"), F.col("best.chars").alias("keep_chars"), "copies",
                F.col("best.row").alias("keep_row"),
            )
        )
        # Written, or Spark would move the anti-join below the grouping, where a digest of very many copies is in one task.
        batch = written(batch, "batch-digests")
        known = self.rows().select("digest")
        fresh = written(batch.join(known.hint("merge"), "digest", "left_anti"), "new-digests")
        older = written(
            batch.alias("b").join(self.rows().alias("i").hint("merge"), "digest")
            .select("digest", "i.keep_id", (F.col("b.copies") + F.col("i.copies")).alias("copies"), F.lit(None).cast("bigint").alias("keep_row")),
            "known-digests",
        )
        self._append(fresh.drop("keep_row"))
        groups = fresh.select("digest", "keep_id", "copies", "keep_row").unionByName(older)
        # Both sides of this join are shuffled, so Spark may split the partition of a digest with very many copies.
        return signed.join(groups, "digest").select(
            "doc_id",
            "keep_id",
            F.col("copies").alias("group_size"),
            F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
            F.col("digest").alias("text_sha256"),
            "row",
        )


def _against_nothing(docs: DataFrame, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    index = DigestIndex.temporary(docs.sparkSession)
    found = index.ingest(docs, id_col, text_col, row_col)
    index.close()  # the result reads tables of its own
    return found


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row, against a new index."""
    return _against_nothing(docs, id_col, text_col).drop("row")


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, with its own columns only."""
    number = "__row"
    while number in docs.columns:
        number += "_"
    # Written, so that a row has the same number wherever it is read.
    numbered = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered", "zstd")
    dropped = _against_nothing(numbered, id_col, text_col, number).where("not kept").select(F.col("row").alias("__dropped"))
    # Columns go by their table, so that no name of the documents can clash.
    return numbered.join(dropped, numbered[number] == dropped["__dropped"], "left_anti").drop(number)
