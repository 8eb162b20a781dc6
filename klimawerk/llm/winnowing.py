"""Benchmark decontamination by winnowing.

Of every ``window - k + 1`` consecutive ``k``-word grams the one with the smallest hash is kept, in benchmark items and in
documents, so a passage of ``window`` words that both share has a kept gram in common. Kept grams are joined by hash; each
pair is then extended word by word to both sides, and counts if ``window`` words agree. An item of fewer words than the
window is one window: its whole word sequence is its fingerprint, looked up among all grams of that length.

Before the join a document's grams are tested against a bitmap of the benchmark's hashes. The bitmap has a fixed size, so
it can always be broadcast; a fuller one lets more grams through to the join and loses none.

Defined results: a null or empty text has no words, and an item without words matches nothing. Repeated items of one id
count once; an item without id goes by the empty string. A repeated document row gets the same result as the first. No
items give documents without hits; no documents give an empty result. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klimawerk.llm.storage import slots_bitmap, text_key, without, written
from klimawerk.llm.text import NOT_ALNUM, chunks, gram_hashes, grams, in_bitmap, minima, mix, word_hashes, words

WINDOW, GRAM = 10, 5

_PRINTS = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32()), ("size", pa.int32()), ("lead", pa.int32()), ("around", pa.string())]))
_SPARK_PRINTS = "array<struct<h: bigint, at: int, size: int, lead: int, around: string>>"


def _tagged(hashes: np.ndarray, size: int) -> np.ndarray:
    return mix(hashes + np.uint64(size * 0x9E3779B97F4A7C15 % (1 << 64)))


def _context(w, i: int, at: int, size: int, reach: int) -> tuple[int, str]:
    """Words around a gram that can share a window with it: how many stand before it, and all of them."""
    low, high = max(int(w.first[i]), at - reach), min(int(w.first[i + 1]), at + size + reach)
    return at - low, " ".join(w.data[w.start[j]:w.end[j]].decode("utf-8") for j in range(low, high))


def _item_prints(texts: list[bytes], window: int, k: int) -> list[list[dict]]:
    w = words(texts, NOT_ALNUM, lower=True)
    hashes = word_hashes(w)
    g = grams(w, hashes, k)
    out: list[list[dict]] = [[] for _ in texts]
    for p in minima(g.hash, g.first, window - k + 1).tolist():
        at = int(g.word[p])
        i = int(w.text[at])
        if w.first[i + 1] - w.first[i] >= window:
            lead, around = _context(w, i, at, k, window - k)
            h = int(_tagged(g.hash[p:p + 1], k).view(np.int64)[0])
            out[i].append({"h": h, "at": at - int(w.first[i]), "size": k, "lead": lead, "around": around})
    for i in range(len(texts)):
        n = int(w.first[i + 1] - w.first[i])
        if 0 < n < window:
            whole = gram_hashes(hashes[w.first[i]:w.first[i + 1]], n)
            h = int(_tagged(whole, 64 + n).view(np.int64)[0])
            lead, around = _context(w, i, int(w.first[i]), n, 0)
            out[i].append({"h": h, "at": 0, "size": 64 + n, "lead": lead, "around": around})
    return out


def _doc_prints(texts: list[bytes], window: int, k: int, bitmap: np.ndarray, short: list[int]) -> tuple[np.ndarray, list[list[dict]]]:
    w = words(texts, NOT_ALNUM, lower=True)
    hashes = word_hashes(w)
    out: list[list[dict]] = [[] for _ in texts]

    def keep(g, places, size, length, reach):
        tagged = _tagged(g.hash[places], size)
        hit = in_bitmap(bitmap, tagged)
        for p, h in zip(places[hit].tolist(), tagged[hit].view(np.int64).tolist()):
            at = int(g.word[p])
            i = int(w.text[at])
            lead, around = _context(w, i, at, length, reach)
            out[i].append({"h": h, "at": at - int(w.first[i]), "size": size, "lead": lead, "around": around})

    g = grams(w, hashes, k)
    keep(g, minima(g.hash, g.first, window - k + 1), k, k, window - k)
    for n in short:
        g = grams(w, hashes, n)
        keep(g, np.arange(len(g.hash)), 64 + n, n, 0)
    return np.diff(w.first), out


def _common(ours: str, lead: int, theirs: str, their_lead: int, size: int, window: int) -> tuple[int, int] | None:
    """Words to the left and right of a shared gram that agree too, if they fill a window with it."""
    if size > 64:
        return (0, size - 64) if ours == theirs else None
    a, b = ours.split(" "), theirs.split(" ")
    if a[lead:lead + size] != b[their_lead:their_lead + size]:
        return None
    left = 0
    while left < min(lead, their_lead) and a[lead - left - 1] == b[their_lead - left - 1]:
        left += 1
    right = size
    while lead + right < len(a) and their_lead + right < len(b) and a[lead + right] == b[their_lead + right]:
        right += 1
    return (left, right) if left + right >= window else None


def item_fingerprints(items: DataFrame, id_col: str, text_col: str, window: int = WINDOW, k: int = GRAM) -> DataFrame:
    def sign(batches):
        for batch in batches:
            for begin, texts in chunks(batch.column(1)):
                prints = _item_prints(texts, window, k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, len(texts)), pa.array(prints, _PRINTS)], ["item", "prints"]
                )

    source = items.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text")
    )
    signed = source.mapInArrow(sign, f"item string, prints {_SPARK_PRINTS}")
    return written(signed.select("item", F.explode("prints").alias("p")).select("item", "p.*").distinct(), "item-prints")


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, k: int = GRAM,
) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    spark = docs.sparkSession
    prints = item_fingerprints(items, item_col, item_text_col, window, k)
    short = sorted(r[0] - 64 for r in prints.where("size > 64").select("size").distinct().collect())
    bitmap = spark.sparkContext.broadcast(slots_bitmap(prints, F.col("h")))

    def sign(batches):
        for batch in batches:
            for begin, texts in chunks(batch.column(3)):
                n_words, found = _doc_prints(texts, window, k, bitmap.value, short)
                own = [batch.column(c).slice(begin, len(texts)) for c in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(n_words, pa.int64()), pa.array(found, _PRINTS)],
                    ["row", "doc_id", "text_key", "n_words", "prints"],
                )

    source = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"),
        text_key(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"),
    )
    # Written once: the row numbers are then the same for all that follows.
    signed = written(
        source.mapInArrow(sign, f"row bigint, doc_id bigint, text_key bigint, n_words bigint, prints {_SPARK_PRINTS}"), "doc-prints"
    )
    found = signed.select("row", F.explode("prints").alias("p")).select("row", "p.*")
    theirs = prints.select("item", "h", F.col("size").alias("item_size"), F.col("lead").alias("item_lead"), F.col("around").alias("item_around"))

    def extend(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                span = _common(r["around"], r["lead"], r["item_around"], r["item_lead"], r["size"], window)
                if span and r["size"] == r["item_size"]:
                    rows.append({"row": r["row"], "low": r["at"] - span[0], "high": r["at"] + span[1], "item": r["item"]})
            yield pa.RecordBatch.from_pylist(
                rows, pa.schema([("row", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("item", pa.string())])
            )

    hits = found.join(theirs, "h").select(
        "row", "at", "size", "lead", "around", "item", "item_size", "item_lead", "item_around"
    ).mapInArrow(extend, "row bigint, low int, high int, item string")
    # Spans of one text, each once: as many as the text has words at most.
    per_row = hits.groupBy("row").agg(
        F.sort_array(F.collect_set(F.struct("low", "high"))).alias("spans"), F.sort_array(F.collect_set("item")).alias("items")
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("until")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(x["high"] - F.greatest(x["low"], s["until"]), F.lit(0))).alias("n"),
            F.greatest(s["until"], x["high"]).alias("until"),
        ),
    )["n"]
    counted = per_row.select(
        F.col("row").alias("hit_row"), covered.cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
    )
    return signed.select("row", "doc_id", "text_key", "n_words").join(counted, F.col("row") == F.col("hit_row"), "left").select(
        "doc_id", "text_key", "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def without_contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, k: int = GRAM,
) -> DataFrame:
    """The documents that share no window with an item, with their own columns only."""
    found = contamination(docs, items, id_col, text_col, item_col, item_text_col, window, k)
    return without(docs, found.where("contaminated"), id_col, text_col)
