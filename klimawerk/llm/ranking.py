"""Ranked lexical search: accumulator-limited, a term at a time, over all documents for all items at once.

The terms of every item are taken rarest first, in rounds of ever more terms. A round joins the postings of its terms to the
items, and adds to the accumulators (item, document) or creates them. Each term has an upper bound of what it can add to any
document, so the bounds of an item's terms from some place on bound the score of a document not yet met. Once that is below
the item's k-th best partial score, its remaining terms create no more accumulators. Accumulators that can still reach that
score, ties included, survive, and get what the remaining terms add to them exactly.

Scores are whole numbers and the bounds hold exactly, so the result is that of scoring every document.

Documents are read once: words that no item holds go by a bitmap of their hashes, the rest are exact terms. The postings of a
common term are spread over the files they were written to, and no accumulator is kept for it unless the item has nothing
rarer. Item tables are joined without hints, so Spark broadcasts them only when they have been measured to be small.

Defined results: a null text has no terms, and neither has an empty one; such documents are not counted. Repeated rows of
documents are ranked each on its own, and repeated rows of items too. Null ids are kept; among equal scores a null doc_id
comes last. An item without a match gives no row, and an empty table of either kind gives an empty result. Other columns are
ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from klimawerk.llm.storage import slots_bitmap, written
from klimawerk.llm.text import NOT_ALNUM, chunks, in_bitmap, word_hashes, words

BEST = 10
FIRST_ROUND = 8
"""Terms of an item that the first round takes; all later rounds together double what is done."""

_TERM = pa.struct([("term", pa.string()), ("hash", pa.int64()), ("tf", pa.int64())])
_IMPACT = "(1000000000 * t.tf) div (1000 * t.tf + 8 * m)"
"""What one occurrence of a term in an item adds for a document that holds it ``tf`` times, but for the term's weight."""
_SCHEMA = "row bigint, id bigint, n bigint, terms array<struct<term: string, hash: bigint, tf: bigint>>"


def _counted(texts: list[bytes], bitmap: np.ndarray | None) -> tuple[np.ndarray, pa.Array]:
    """Number of words of each text, and its distinct terms in the bitmap with their frequencies."""
    w = words(texts, NOT_ALNUM, lower=True)
    hashes = word_hashes(w)
    at = np.arange(len(hashes)) if bitmap is None else np.flatnonzero(in_bitmap(bitmap, hashes))
    at = at[np.lexsort((hashes[at], w.text[at]))]
    first = np.ones(len(at), dtype=bool)
    first[1:] = (w.text[at[1:]] != w.text[at[:-1]]) | (hashes[at[1:]] != hashes[at[:-1]])
    begin = np.flatnonzero(first)
    tf = np.diff(np.append(begin, len(at)))
    own = at[begin]
    terms = [w.data[s:e].decode("utf-8") for s, e in zip(w.start[own].tolist(), w.end[own].tolist())]
    limits = np.searchsorted(w.text[own], np.arange(len(texts) + 1)).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(hashes[own].view(np.int64)), pa.array(tf)], fields=list(_TERM))
    return np.diff(w.first), pa.ListArray.from_arrays(pa.array(limits), values)


def terms(df: DataFrame, id_col: str, text_col: str, name: str, bitmap: np.ndarray | None = None) -> DataFrame:
    """(row, id, n, terms) of each row of a table, written; with a bitmap only terms that are in it."""
    shared = df.sparkSession.sparkContext.broadcast(bitmap)

    def count(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in chunks(batch.column(2)):
                n, found = _counted(texts, shared.value)
                part = batch.slice(begin, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), found], ["row", "id", "n", "terms"])

    source = df.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")
    )
    return written(source.mapInArrow(count, _SCHEMA), name)


def _plan(items: DataFrame, postings: DataFrame, total: int) -> DataFrame:
    """(item, place, term, weight, remaining): an item's terms, rarest first; what these and all later ones can add at most.

    An item's distinct terms are no more than its text, which one task held already.
    """
    stats = postings.groupBy("term").agg(F.count("*").alias("df"), F.max("impact").alias("most"))
    one = items.select(F.col("row").alias("item"), F.explode("terms").alias("t")).select("item", "t.term", F.col("t.tf").alias("times"))
    w = F.floor(1000 * F.log((2.0 * total + 2) / (2 * F.col("df") + 1)))
    weighed = one.join(stats, "term").select("item", "df", "term", (F.col("times") * w).alias("weight"), "most")
    rarest = Window.partitionBy("item").orderBy("df", "term")
    after = rarest.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    place = (F.row_number().over(rarest) - 1).cast("bigint").alias("place")
    return written(weighed.select("item", place, "term", "weight", F.sum(F.col("weight") * F.col("most")).over(after).alias("remaining")), "item-plan")


def _leading(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best accumulators of each item."""
    best = Window.partitionBy("item").orderBy(F.desc("score"), "row")
    return scores.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")


def _added(scores: DataFrame, rest: DataFrame, docs: DataFrame) -> DataFrame:
    """(item, row, score): what each of the given terms of an item adds to its accumulators."""
    met = docs.select("row", "m", "terms").join(scores.select("item", "row"), "row").select("item", "row", "m", F.explode("terms").alias("t"))
    later = met.select("item", "row", F.col("t.term").alias("term"), F.expr(_IMPACT).alias("impact")).join(rest, ["item", "term"])
    return later.select("item", "row", (F.col("weight") * F.col("impact")).alias("score"))


def _accumulated(plan: DataFrame, postings: DataFrame, docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(item, row, score) of the surviving accumulators; (item, upto): the first place that an item has not taken."""
    spark = plan.sparkSession
    scores = spark.createDataFrame([], "item bigint, row bigint, score bigint")
    state = spark.createDataFrame([], "item bigint, upto bigint, ahead bigint, kth bigint")
    low, high = 0, FIRST_ROUND
    while True:
        # Bounds fall from place to place and the k-th score only rises, so an item that has stopped stays so.
        known = plan.join(state.select("item", "upto", "kth"), "item", "left").withColumn("upto", F.coalesce("upto", F.lit(0)))
        active = (F.col("upto") == low) & F.col("place").between(low, high - 1) & F.expr("remaining >= coalesce(kth, 1)")
        # Written, so that its size is known before the postings or the documents' terms would be shuffled for it.
        known = written(known.where("place >= upto").withColumn("active", active), "item-terms")
        more = postings.join(known.where("active").select("item", "term", "weight"), "term")
        more = more.select("item", "row", (F.col("weight") * F.col("impact")).alias("score")).where("score > 0")
        scores = written(scores.unionByName(more).groupBy("item", "row").agg(F.sum("score").alias("score")), "accumulators")
        # The leading documents are scored to the end, which gives a k-th score that the later terms are part of.
        leading = written(_leading(scores, k), "leading")
        whole = leading.unionByName(_added(leading, known.where("not active").select("item", "term", "weight"), docs))
        parts = whole.selectExpr("item", "row", "score", "NULL AS upto", "NULL AS ahead", "NULL AS kth").unionByName(
            known.selectExpr("item", "NULL AS row", "NULL AS score", "if(active, place + 1, upto) AS upto", "if(active, 0, remaining) AS ahead", "kth")
        ).unionByName(state.selectExpr("item", "NULL AS row", "NULL AS score", "upto", "CAST(0 AS BIGINT) AS ahead", "kth"))
        state = written(
            parts.repartition("item")
            .groupBy("item", "row").agg(F.sum("score").alias("score"), *[F.max(c).alias(c) for c in ("upto", "ahead", "kth")])
            .groupBy("item").agg(
                F.max("upto").alias("upto"), F.max("ahead").alias("ahead"),
                F.greatest(F.max("kth"), F.when(F.count("row") == k, F.min("score"))).alias("kth"),
            ),
            "item-state",
        )
        # Those that can't reach the k-th score any more are given up; met again, they still can't.
        scores = scores.join(state, "item").where("score + ahead >= coalesce(kth, 1)").select("item", "row", "score")
        if state.where(F.col("upto") == high).isEmpty():
            return scores, state.select("item", "upto")
        low, high = high, 2 * high


def ranked_documents(
    docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score of the best ``k`` documents of every item."""
    wanted = terms(items, item_col, item_text_col, "item-words")
    bitmap = slots_bitmap(wanted.select(F.explode("terms").alias("t")), F.col("t.hash"))
    found = terms(docs, id_col, text_col, "document-words", bitmap).where("n > 0")
    counts = found.agg(F.count("*").alias("total"), F.sum("n").alias("length")).first()
    total, length = counts["total"], counts["length"] or 1
    found = found.withColumn("m", F.expr(f"100 - 75 + (75 * n * {total}L) div {length}L"))
    exact = wanted.select(F.explode("terms").alias("t")).select("t.term").distinct()
    postings = found.select("row", "m", F.explode("terms").alias("t")).select(F.col("t.term").alias("term"), "row", F.expr(_IMPACT).alias("impact"))
    postings = written(postings.join(exact, "term", "left_semi"), "postings")
    plan = _plan(wanted, postings, total)
    scores, taken = _accumulated(plan, postings, found, k)
    survivors = written(scores, "survivors")
    rest = written(plan.join(taken, "item").where("place >= upto").select("item", "term", "weight"), "rest-terms")
    whole = survivors.unionByName(_added(survivors, rest, found)).groupBy("item", "row").agg(F.sum("score").alias("score"))
    named = whole.where("score > 0").join(found.select("row", F.col("id").alias("doc_id")), "row")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    top = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ids = wanted.select(F.col("row").alias("item"), F.col("id").alias("item_id"))
    return top.join(ids, "item").select("item_id", "rank", "doc_id", "score")
