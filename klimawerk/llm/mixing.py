"""Mixing sources to target weights.

The words of a source, its documents in a fixed pseudorandom order, are packed into blocks of ``block_words``. A source's
target gives a number of slots. The slots of all sources are put in a pseudorandom order, and each ``shard_slots`` of them are
an output shard: a shard's source counts are thereby a multinomial draw of fixed length, on the condition that each source gets
exactly its slots, without which neither targets nor the bound on repeats would hold. A slot's number within its source is
mapped through a pseudorandom permutation of the source's blocks, another one for each pass over them, and blocks are joined to
slots by index.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the size of all sources; a target
stops at ``most_passes`` times its source's size, and the excess is shared by weight among the others until none is above.
As no block is drawn more often than there are passes, no document exceeds that multiple of its size either.

Sources are a table too, however many; the driver gets single sums of it. A source of any size is spread over parts of about
``PART_ROWS`` documents, whose offsets are added up from the sums of the parts, and its slots over runs of ``RUN``.

Defined results: a null or empty text has size 0, takes part in no block and is taken 0 times. A null source is a source of
its own. A repeated row counts as a document of its own. Null ids are kept. An empty table gives an empty result, sources
without words get target 0. Other columns are ignored, whatever they are called. Reruns agree: all draws depend on the seed
and the contents only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from klimawerk.llm.ranks import ranked, sums_before
from klimawerk.llm.storage import text_key, written
from klimawerk.llm.text import mix

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
BLOCK_WORDS = 64
SHARD_SLOTS = 1 << 16
PASSES = 3
PART_ROWS = 20_000
RUN = 1 << 14
PIECE_WORDS = 1 << 18


def _share(sizes: DataFrame, most_passes: int) -> float:
    """What a source gets per unit of weight, after the excess of those at their limits is shared among the others."""
    limit = F.col("size") * most_passes
    total, weight = sizes.agg(F.sum("size"), F.sum("weight")).first()
    share, before = (total / weight if weight else 0.0), 0
    while True:
        # The share only grows, so a source once above its limit stays so.
        above = F.lit(share) * F.col("weight") > limit
        n, held, weight = sizes.agg(
            F.count(F.when(above, 1)), F.sum(F.when(above, limit).otherwise(0)), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if n == before or not weight:
            return share
        share, before = (total - held) / weight, n


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_passes: int = PASSES) -> DataFrame:
    """(number, source, size, target) of each source, from (source, size), one row each."""
    at = ranked(sizes.select("source", "size", F.lit(0).alias("all")), "all", [F.col("source").asc_nulls_last()], "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    numbered = written(at.select(F.col("rank").alias("number"), "source", "size", weight.alias("weight")), "weights")
    share = _share(numbered, most_passes)
    target = F.least(F.lit(share) * F.col("weight"), (F.col("size") * most_passes).cast("double"))
    return numbered.select("number", "source", "size", target.alias("target"))


def _sources(sized: DataFrame, block_words: int) -> DataFrame:
    """(number, source, source_size, target, blocks, slots, start): a source's blocks, the slots it fills, those of sources before."""
    found = targets(sized.groupBy("source").agg(F.sum("size").alias("size")))
    blocks = F.expr(f"(size + {block_words - 1}) div {block_words}")
    planned = found.withColumn("blocks", blocks).withColumns({
        "slots": F.when(
            F.col("blocks") > 0, F.least(PASSES * F.col("blocks"), F.bround(F.col("target") * F.col("blocks") / F.col("size")).cast("bigint"))
        ).otherwise(F.lit(0).cast("bigint")),
        "all": F.lit(0),
    })
    started = sums_before(planned, "all", "number", {"slots": "start"}, "planned").withColumnRenamed("size", "source_size")
    return written(started.drop("all"), "slots")


def permuted(index: np.ndarray, n: int | np.ndarray, key: np.ndarray) -> np.ndarray:
    """Image of each index below its ``n`` under the pseudorandom permutation of its key: a Feistel network, walked until below."""
    n = np.broadcast_to(np.asarray(n, dtype=np.int64), index.shape)
    bits = np.frexp(np.maximum(n - 1, 1).astype(np.float64))[1]
    half = np.maximum(1, (bits + 1) // 2).astype(np.uint64)
    mask, limit = (np.uint64(1) << half) - np.uint64(1), n.astype(np.uint64)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        shift, low = half[todo], mask[todo]
        left, right = out[todo] >> shift, out[todo] & low
        for turn in range(4):
            left, right = right, left ^ (mix(right + key[todo] + np.uint64(turn * 0x9E3779B9)) & low)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= limit[todo]]
    return out.astype(np.int64)


def drawn_slots(sources: DataFrame, seed: int = 0, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(number, block, shard, position, draw): which block fills the ``draw``-th slot of a source, and where that slot lies.

    Spark estimates the size of this table by its sources, far below its rows, so a join to it must state that it is large.
    """
    total = sources.agg(F.sum("slots")).first()[0] or 0
    fields = ["number", "block", "shard", "position", "draw"]

    def drawn(number, blocks, start, low, n) -> pa.RecordBatch:
        of = np.repeat(np.arange(len(n)), n)
        at = low[of] + np.arange(len(of)) - (np.cumsum(n) - n)[of]
        around, number = blocks[of], number[of]
        key = mix((at // around).astype(np.uint64) + np.uint64(seed << 32) + (number.astype(np.uint64) << np.uint64(8)))
        block = permuted(at % around, around, key)
        place = permuted(start[of] + at, total, np.broadcast_to(mix(np.array([seed], dtype=np.uint64)), at.shape))
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (number, block, place // shard_slots, place % shard_slots, at)], fields
        )

    def draw(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, blocks, slots, start, run = (batch.column(c).to_numpy() for c in range(5))
            low = run * RUN
            n = np.minimum(slots - low, RUN)
            # Several short runs are drawn together.
            group = np.cumsum(n) // RUN
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(n)]
            for a, b in zip(edges, edges[1:]):
                if a < b:
                    yield drawn(number[a:b], blocks[a:b], start[a:b], low[a:b], n[a:b])

    runs = sources.where("slots > 0").select(
        "number", "blocks", "slots", "start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(slots - 1) div {RUN}"))).alias("run")
    )
    tasks = min(max(1, -(-total // shard_slots)), 1 << 14)
    return runs.repartition(tasks).mapInArrow(draw, "number bigint, block bigint, shard bigint, position bigint, draw bigint")


def _placed(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds number, source_size, target and the first word's place in the source's stream of words."""
    known = sources.select("number", F.col("source").alias("__source"), "source_size", "target")
    rows = sized.join(known, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    parts = max(16, -(-sized.count() // PART_ROWS))
    # Rows that are equal here have equal id and text, so their order does not matter.
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "key"), F.lit(parts)))
    before = Window.partitionBy("number").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("number", "part").agg(F.sum("size").alias("part_size")).select(
        "number", "part", F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("base")
    )
    inside = Window.partitionBy("number", "part").orderBy("doc_id", "size", "key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(base, ["number", "part"]).withColumn("first", F.col("base") + F.col("inside")).drop("base", "inside", "part", "key")


def _pieces(placed: DataFrame, block_words: int) -> DataFrame:
    """One row for each block that a document reaches into."""
    last = F.col("first") + F.col("size") - 1
    blocks = F.sequence(F.floor(F.col("first") / block_words), F.floor(last / block_words))
    return placed.where("size > 0").withColumn("block", F.explode(blocks)).withColumns({
        "low": F.greatest(F.col("block") * block_words - F.col("first"), F.lit(0)),
        "high": F.least((F.col("block") + 1) * block_words - F.col("first"), F.col("size")),
    })


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more) -> DataFrame:
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        text_key(F.col(text_col).cast("string")).alias("key"),
        *more,
    )


def mixture(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, source of every row: how many of its words the mix takes."""
    sized = written(_sized(docs, id_col, text_col, source_col), "sizes")
    sources = _sources(sized, block_words)
    placed = written(_placed(sized, sources), "placed")
    times = drawn_slots(sources, seed).groupBy("number", "block").agg(F.count("*").alias("times"))
    taken = (
        _pieces(placed, block_words).join(times.hint("merge"), ["number", "block"])
        .groupBy("row").agg(F.sum((F.col("high") - F.col("low")) * F.col("times")).alias("taken"))
    )
    return placed.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken"), "source"
    )


def mixed_blocks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The mix itself, a row per slot: shard, position (from 0, without gaps within the shard), source, block, doc_ids, text.

    A block's text is its words joined by single spaces. Doc_ids are those of the documents in the block, in order.
    """
    sources = _sources(_sized(docs, id_col, text_col, source_col).select("source", "size"), block_words)
    placed = _placed(_sized(docs, id_col, text_col, source_col, F.col(text_col).cast("string").alias("text")), sources)
    fields = ["number", "source", "block", "low", "doc_id", "text"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def cut(batches):
        for batch in batches:
            out, held = [], 0
            for number, source, doc_id, first, text in zip(*(batch.column(c) for c in range(5))):
                number, source, doc_id, first, words = number.as_py(), source.as_py(), doc_id.as_py(), first.as_py(), text.as_py().encode("utf-8").split()
                edges = [0, *range(block_words - first % block_words, len(words), block_words), len(words)]
                for i, (a, b) in enumerate(zip(edges, edges[1:])):
                    out.append((number, source, first // block_words + i, first + a, doc_id, b" ".join(words[a:b]).decode("utf-8")))
                    held += b - a
                    if held >= PIECE_WORDS:
                        yield batch_of(out)
                        out, held = [], 0
            if out:
                yield batch_of(out)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], fields)

    pieces = placed.where("size > 0").select("number", "source", "doc_id", "first", "text").mapInArrow(
        cut, "number bigint, source string, block bigint, low bigint, doc_id bigint, text string"
    )
    # A block holds block_words words at most, so its pieces are few.
    blocks = pieces.groupBy("number", "block").agg(
        F.first("source").alias("source"), F.sort_array(F.collect_list(F.struct("low", "doc_id", "text"))).alias("parts")
    )
    slots = drawn_slots(sources, seed).hint("merge")
    return slots.join(blocks, ["number", "block"]).select(
        "shard", "position", "source", "block",
        F.col("parts.doc_id").alias("doc_ids"), F.array_join("parts.text", " ").alias("text"),
    )
