"""Substring deduplication by sparse suffix arrays.

Suffixes are kept at the words that a minimiser selects: of every ``window`` consecutive ``SEED``-word grams of a text the one
with the smallest hash. Equal passages select equal places, so two passages of ``min_words`` equal words have a selected word
in common that has at least ``min_words - window + 1`` equal words to the right (its head). Suffixes whose head occurs once
cannot be part of a repeat and are dropped. The others are sorted over the whole corpus and compared with their neighbours,
which gives the longest match to the right; sorted by head and the words before it in reverse, neighbours give the longest
match to the left. A span is reported if both together reach ``min_words``, and spans of a text that overlap are merged. So
every passage of ``min_words`` words that occurs twice is reported, and every reported word lies in a passage of at least
a head that occurs twice.

Sorting deals suffixes by range, with the place as the last key, so suffixes of one passage in any number may fall into many
tasks. The first and last suffix of each task are compared in a second step, which reads two rows per task.

Defined results: words are separated by blanks and compared as they are. A null text has no words. Repeated rows repeat each
other's passages. Null ids are kept. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klimawerk.llm.storage import slots_bitmap, text_key, written
from klimawerk.llm.text import BLANK, chunks, gram_hashes, grams, in_bitmap, minima, word_hashes, words

MIN_WORDS, WINDOW, SEED = 50, 25, 4


def _selected(docs: DataFrame, id_col: str, text_col: str, head: int, window: int) -> DataFrame:
    """(head, doc_id, text_key, at) of each selected word with a whole head."""
    fields = ["head", "doc_id", "text_key", "at"]

    def select(batches):
        for batch in batches:
            for begin, texts in chunks(batch.column(2)):
                w = words(texts, BLANK, lower=False)
                hashes = word_hashes(w)
                seeds = grams(w, hashes, SEED)
                at = seeds.word[minima(seeds.hash, seeds.first, window)]
                text = w.text[at]
                whole = at + head <= w.first[text + 1]
                at, text = at[whole], text[whole]
                heads = gram_hashes(hashes, head)
                ids = [batch.column(c).slice(begin, len(texts)).take(pa.array(text)) for c in range(2)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((heads[at] if len(at) else at.astype(np.uint64)).view(np.int64)), *ids,
                     pa.array((at - w.first[text]).astype(np.int32))],
                    fields,
                )

    source = _source(docs, id_col, text_col)
    return source.mapInArrow(select, "head bigint, doc_id bigint, text_key bigint, at int")


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), text_key(text_col).alias("text_key"),
        F.col(text_col).cast("string").alias("text"),
    )


def _with_contexts(docs: DataFrame, places: DataFrame, id_col: str, text_col: str, head: int, reach: int) -> DataFrame:
    """(head, doc_id, text_key, at, before, after): 32-bit hashes of ``reach`` words to both sides, nearest first."""
    fields = ["head", "doc_id", "text_key", "at", "first_id", "before", "after"]
    per_text = places.groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("at", "head", "first_id")).alias("places")
    ).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "places")
    bitmap = docs.sparkSession.sparkContext.broadcast(slots_bitmap(per_text, F.xxhash64("__id", "__key")))

    def may_have(batches):
        for batch in batches:
            key = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.filter(pa.array(in_bitmap(bitmap.value, key))).select(["doc_id", "text_key", "text"])

    source = _source(docs, id_col, text_col).select("doc_id", "text_key", "text", F.xxhash64("doc_id", "text_key").alias("slot"))
    likely = source.mapInArrow(may_have, "doc_id bigint, text_key bigint, text string")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key"))

    def look(batches):
        for batch in batches:
            for begin, texts in chunks(batch.column(2)):
                w = words(texts, BLANK, lower=False)
                short = (word_hashes(w) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
                listed = batch.column(3).slice(begin, len(texts))
                rows = listed.flatten()
                text = np.repeat(np.arange(len(texts)), np.asarray(listed.value_lengths()))
                at = rows.field("at").to_numpy() + w.first[text]
                steps = np.arange(reach)
                low, high = w.first[text][:, None], w.first[text + 1][:, None]
                before, after = at[:, None] - 1 - steps, at[:, None] + head + steps
                padded = np.append(short, np.uint32(0))
                out = [
                    np.where((side >= low) & (side < high), padded[np.clip(side, 0, len(short))], np.uint32(0)).astype(">u4")
                    for side in (before, after)
                ]
                ids = [batch.column(c).slice(begin, len(texts)).take(pa.array(text)) for c in range(2)]
                yield pa.RecordBatch.from_arrays(
                    [rows.field("head"), *ids, rows.field("at"), rows.field("first_id"),
                     *(pa.array([row.tobytes() for row in side], pa.binary()) for side in out)],
                    fields,
                )

    return likely.join(per_text, same).select("doc_id", "text_key", "text", "places").mapInArrow(
        look, "head bigint, doc_id bigint, text_key bigint, at int, first_id bigint, before binary, after binary"
    )


def _shared(head: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Words that each row shares with the next one, -1 if their heads differ."""
    equal = (side[1:] == side[:-1]) & (side[1:] != 0)
    n = np.where(equal.all(axis=1), side.shape[1], np.argmin(equal, axis=1))
    return np.where(head[1:] == head[:-1], n, -1)


_COMPARED = "doc_id bigint, text_key bigint, at int, first_id bigint, extent int, edge boolean, head bigint, side binary"


def _compare(reach: int):
    """Longest match of each row with a neighbour; the first and last row of a task are marked and keep their keys."""
    def run(batches):
        held = None
        seen = False
        link = -1

        def out(table, shared, edges):
            ids = [table.column(c) for c in ("doc_id", "text_key", "at", "first_id")]
            edge = pa.array(edges)
            masked = [pa.array(table.column(c).to_pylist() if edges.any() else [None] * table.num_rows, t)
                      for c, t in (("head", pa.int64()), ("side", pa.binary()))]
            return pa.RecordBatch.from_arrays(
                [*ids, pa.array(shared.astype(np.int32)), edge, *masked],
                ["doc_id", "text_key", "at", "first_id", "extent", "edge", "head", "side"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            side = np.frombuffer(b"".join(table.column("side").to_pylist()), dtype=">u4").reshape(-1, reach)
            pairs = _shared(table.column("head").to_numpy(), side)
            best = np.maximum(np.append(pairs, -1), np.concatenate([[link], pairs]))
            last = table.num_rows - 1
            if last and not seen:
                yield out(table.slice(0, 1), best[:1], np.ones(1, dtype=bool))
                seen = True
                if last > 1:
                    yield out(table.slice(1, last - 1), best[1:last], np.zeros(last - 1, dtype=bool))
            elif last:
                yield out(table.slice(0, last), best[:last], np.zeros(last, dtype=bool))
            held, link = table.slice(last), int(pairs[-1]) if last else link
        if held is not None:
            yield out(held, np.array([link]), np.ones(1, dtype=bool))

    return run


def _extents(contexts: DataFrame, column: str, reach: int, name: str) -> DataFrame:
    """(doc_id, text_key, at, first_id, extent): the longest match to one side among suffixes of equal head."""
    rows = contexts.select("head", F.col(column).alias("side"), "doc_id", "text_key", "at", "first_id")
    keys = ["head", "side", "doc_id", "text_key", "at"]
    compared = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_compare(reach), _COMPARED), name)
    # Two rows per task: small, however large the corpus.
    edges = compared.where("edge").select("head", "side", "doc_id", "text_key", "at", "first_id")
    edges = edges.coalesce(1).sortWithinPartitions(*keys).mapInArrow(_compare(reach), _COMPARED)
    return compared.unionByName(edges).select("doc_id", "text_key", "at", "first_id", "extent")


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, window: int = WINDOW
) -> DataFrame:
    """doc_id, text_key, start_word, end_word, n_words, first_id of each span; ``first_id`` has its earliest occurrence."""
    head = min_words - window + 1
    reach = window
    selected = written(_selected(docs, id_col, text_col, head, window), "suffixes")
    # Only heads that occur twice; counts are combined before the exchange. Written, so that both sides of the join are
    # shuffled for it and Spark may split the partition of a very common head.
    repeated = selected.groupBy("head").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")
    repeated = written(repeated.drop("n"), "common-heads")
    places = written(selected.join(repeated, "head").select("head", "doc_id", "text_key", "at", "first_id"), "repeated-heads")
    contexts = _with_contexts(docs, places, id_col, text_col, head, reach)
    contexts = written(contexts, "contexts")
    sides = _extents(contexts, "before", reach, "before").select("*", F.lit(True).alias("left")).unionByName(
        _extents(contexts, "after", reach, "after").select("*", F.lit(False).alias("left"))
    )
    spans = sides.groupBy("doc_id", "text_key", "at").agg(
        F.greatest(F.max(F.when(F.col("left"), F.col("extent"))), F.lit(0)).alias("before"),
        F.greatest(F.max(F.when(~F.col("left"), F.col("extent"))), F.lit(0)).alias("after"),
        F.min("first_id").alias("first_id"),
        F.max("extent").alias("matched"),
    ).where(f"matched >= 0 and before + after + {head} >= {min_words}")
    merged = spans.groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_list(F.struct(
            (F.col("at") - F.col("before")).alias("low"), (F.col("at") + head + F.col("after")).alias("high"), "first_id"
        ))).alias("spans")
    )

    def merge(batches):
        fields = ["doc_id", "text_key", "start_word", "end_word", "n_words", "first_id"]
        for batch in batches:
            rows = []
            for doc_id, key, listed in zip(*(batch.column(c).to_pylist() for c in range(3))):
                low = high = first = None
                for span in [*listed, None]:
                    if span is not None and low is not None and span["low"] <= high:
                        high = max(high, span["high"])
                        first = min((x for x in (first, span["first_id"]) if x is not None), default=None)
                        continue
                    if low is not None:
                        rows.append((doc_id, key, low, high, high - low, first))
                    if span is not None:
                        low, high, first = span["low"], span["high"], span["first_id"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 6, fields)

    return merged.mapInArrow(
        merge, "doc_id bigint, text_key bigint, start_word bigint, end_word bigint, n_words bigint, first_id bigint"
    )
