"""Substring deduplication by hashing lines and the sentences inside them.

Units are normalised (lower case, single blanks), digested and grouped over the whole corpus. The occurrence in the document
of smallest id stays, and of several in that document the first; all others are removed, given with their offsets in the
original text. Sentences are looked at beside whole lines, so a passage that repeats inside longer lines is found as well.

Every line that is not blank is a unit, however short. Sentences inside a line are units from ``sentence_bytes`` bytes of
normalised UTF-8 on, so texts without blanks count as others do; shorter ones repeat by chance. A line of one sentence is a
line only.

Defined results: a null or empty text has no units. Rows without id rank last. Rows of one id count as one document: they do
not remove each other's units. A repeat inside a row is removed. An empty table gives an empty result. Other columns are
ignored, whatever they are called.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klimawerk.llm.storage import text_key, written

SENTENCE_BYTES = 48
LAST_RANK = (1 << 63) - 1

_LINE = re.compile(r"[^\n]+")
_SENTENCE = re.compile(r"[^.!?。！？]+[.!?。！？]*")


def _normal(part: str) -> bytes:
    return " ".join(part.lower().split()).encode("utf-8")


def units(text: str, sentence_bytes: int):
    """(start, end, line, digest) of each unit; ``line`` is where its line starts. Offsets are in code points."""
    for line in _LINE.finditer(text):
        whole = _normal(line.group())
        if not whole:
            continue
        begin = line.start()
        yield begin, line.end(), begin, xxhash.xxh3_128_digest(whole)
        if len(whole) <= sentence_bytes:
            continue
        sentences = list(_SENTENCE.finditer(text, begin, line.end()))
        if len(sentences) < 2:
            continue
        for sentence in sentences:
            part = _normal(sentence.group())
            if len(part) >= sentence_bytes:
                yield sentence.start(), sentence.end(), begin, xxhash.xxh3_128_digest(part)


def _units(docs: DataFrame, id_col: str, text_col: str, sentence_bytes: int) -> DataFrame:
    fields = ["doc_id", "text_key", "digest", "start", "end", "line", "again"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]

    def cut(batches):
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            for doc_id, key, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                seen = set()
                for start, end, line, digest in units(text or "", sentence_bytes):
                    for values, value in zip(out, (doc_id, key, digest, start, end, line, digest in seen)):
                        values.append(value)
                    seen.add(digest)
                if len(out[0]) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], fields)
                    out = [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], fields)

    source = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), text_key(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text")
    )
    return source.mapInArrow(
        cut, "doc_id bigint, text_key bigint, digest binary, start int, end int, line int, again boolean"
    )


def repeated_units(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentence_bytes: int = SENTENCE_BYTES
) -> DataFrame:
    """A row for each removed unit: doc_id, text_key, start, end, line, keep_id (the document whose occurrence stays)."""
    # Cut twice rather than kept: the units of a corpus take more room than its texts.
    found = _units(docs, id_col, text_col, sentence_bytes)
    rank = F.coalesce("doc_id", F.lit(LAST_RANK))
    # Minima and counts are combined before the exchange, whatever the number of occurrences.
    repeated = written(
        found.groupBy("digest").agg(F.min(rank).alias("keep_rank"), F.count("*").alias("n")).where("n > 1").drop("n"), "common-units"
    )
    # Both sides of this join are shuffled for it, so Spark may split the partition of a very common unit.
    removed = written(
        found.join(repeated, "digest").where(F.col("again") | (rank != F.col("keep_rank"))).select(
            "doc_id", "text_key", "start", "end", "line",
            F.when(F.col("keep_rank") != LAST_RANK, F.col("keep_rank")).alias("keep_id"),
        ),
        "repeated-units",
    )
    lines = removed.where("start = line").groupBy("doc_id", "text_key", "line").agg(F.max("end").alias("until")).select(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("line").alias("__line"), "until"
    )
    # A sentence of a removed line goes with the line.
    inside = (
        F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")) & (F.col("line") == F.col("__line"))
        & ((F.col("start") > F.col("line")) | (F.col("end") < F.col("until"))) & (F.col("end") <= F.col("until"))
    )
    return removed.join(lines, inside, "left_anti").distinct()


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """(doc_id, text): every row with its text less the removed units; a null text stays null."""
    spans = (
        repeated_units(docs, id_col, text_col, **limits).groupBy("doc_id", "text_key")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
        .select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "spans")
    )
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (text_key("text") == F.col("__key"))
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def cut(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if spans:
                    parts, at = [], 0
                    for span in spans:
                        parts.append(text[at:max(at, span["start"])])
                        at = max(at, span["end"])
                    text = "".join([*parts, text[at:]])
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return source.join(spans, same, "left").select("doc_id", "text", "spans").mapInArrow(cut, "doc_id bigint, text string")
