"""SimHash near-duplicates: 64-bit fingerprints linked by a binary trie self-join.

Fingerprints of at most ``budget`` differing bits are linked. Each distinct fingerprint is filed in one trie for every choice
of two of ``budget + 2`` bit blocks, with the bits of these blocks first: two fingerprints within the budget agree in at
least two blocks, so some trie holds them below the same node of that depth. Below each such node the trie is joined with
itself: node pairs go down together, add up differing bits, and are dropped when the budget is exceeded.

Only links that join different groups are of use for components, so node pairs whose leaves are known to be of one group
are dropped too, and a task reports a spanning forest instead of all pairs. Nodes with very many leaves are dealt out as
pairs of salted parts.

Defined results: a null text is an empty one; a text without words has fingerprint zero, linked like any other. A text of
fewer words than a shingle is one shingle. Shingles count as often as they occur. A repeated row gets the same result as
the first. Null ids are kept; the smallest id of a component ignores them. An empty table gives an empty result. Other
columns are ignored, whatever they are called.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klimawerk.llm.components import components
from klimawerk.llm.storage import text_key, without, written
from klimawerk.llm.text import LOWER

SEED = 42
CROWDED = 2048
"""Leaves below one node from which it is dealt out in parts."""
FRONTIER = 1 << 18
"""Node pairs that are followed at a time."""


def fingerprint(text: bytes, width: int) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    parts = text.translate(LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    size = min(width, len(parts))
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[:len(parts) - size + 1].tolist(), ends[size - 1:].tolist())
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in spans), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at:at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, text_key, fp): the fingerprint as a signed 64-bit number."""
    def sign(batches):
        for batch in batches:
            values = np.fromiter(
                (fingerprint((t.as_py() or "").encode("utf-8"), width) for t in batch.column(2)), dtype=np.uint64,
                count=batch.num_rows,
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(values.view(np.int64))], ["doc_id", "text_key", "fp"]
            )

    source = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), text_key(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text")
    )
    return source.mapInArrow(sign, "doc_id bigint, text_key bigint, fp bigint")


# --- the tries -------------------------------------------------------------------------------------------------------

def _blocks(budget: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of each block."""
    edges = np.linspace(0, 64, budget + 3).astype(int).tolist()
    return [(low, high - low) for low, high in zip(edges, edges[1:])]


def _file(values: np.ndarray, budget: int):
    """For each trie: its number, its top bits as key, and the fingerprints with these bits first."""
    blocks = _blocks(budget)
    for number, chosen in enumerate(combinations(range(len(blocks)), 2)):
        order = [*chosen, *[i for i in range(len(blocks)) if i not in chosen]]
        moved = np.zeros_like(values)
        for i in order:
            low, bits = blocks[i]
            moved = (moved << np.uint64(bits)) | ((values >> np.uint64(low)) & np.uint64((1 << bits) - 1))
        depth = sum(blocks[i][1] for i in chosen)
        yield number, depth, moved, (np.uint64(number) << np.uint64(40)) | (moved >> np.uint64(64 - depth))


def _roots(links: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Smallest index of each of ``n`` leaves' group."""
    root = np.arange(n)
    a = np.concatenate([x for x, _ in links]) if links else np.zeros(0, dtype=np.int64)
    b = np.concatenate([y for _, y in links]) if links else a
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def _near(x: np.ndarray, y: np.ndarray, budget: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= budget


def trie_forest(leaves: np.ndarray, node: np.ndarray, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that join the same leaves as all links below the given nodes would.

    ``leaves`` are distinct within a node and sorted by (node, leaf); all leaves of a node agree in their first ``depth``
    bits.
    """
    n = len(leaves)
    links = []
    for turn in (0, 16, 32, 48):  # neighbours in a few orders of the bits settle most groups of near copies
        turned = (leaves << np.uint64(turn)) | (leaves >> np.uint64(64 - turn)) if turn else leaves
        order = np.lexsort((turned, node))
        a, b = order[:-1], order[1:]
        linked = (node[a] == node[b]) & _near(leaves[a], leaves[b], budget)
        links.append((a[linked], b[linked]))
    root = _roots(links, n)
    # A run of leaves is of one group if the number of changes up to its ends is the same.
    changes = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])

    ones = {}

    def split(lo, hi, level):
        """Where the leaves whose bit at this level is set begin."""
        if level not in ones:
            bit = (leaves >> np.uint64(63 - level)) & np.uint64(1)
            ones[level] = np.concatenate([[0], np.cumsum(bit)]).astype(np.int64)
        return hi - (ones[level][hi] - ones[level][lo])

    begin = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if n else np.zeros(0, dtype=np.int64)
    end = np.append(begin[1:], n)
    many = end - begin > 1
    begin, end = begin[many], end[many]
    stack = [(depth, begin, end, begin, end, np.zeros(len(begin), dtype=np.int64))]
    while stack:
        level, alo, ahi, blo, bhi, bits = stack.pop()
        same = (changes[alo] == changes[ahi - 1]) & (changes[blo] == changes[bhi - 1]) & (root[alo] == root[blo])
        keep = ~same
        alo, ahi, blo, bhi, bits = alo[keep], ahi[keep], blo[keep], bhi[keep], bits[keep]
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if single.any():
            a, b = alo[single], blo[single]
            linked = _near(leaves[a], leaves[b], budget)
            links.append((a[linked], b[linked]))
            alo, ahi, blo, bhi, bits = (x[~single] for x in (alo, ahi, blo, bhi, bits))
        if not len(alo) or level == 64:
            continue
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            for part in (slice(half, None), slice(0, half)):
                stack.append((level, *(x[part] for x in (alo, ahi, blo, bhi, bits))))
            continue
        amid, bmid = split(alo, ahi, level), split(blo, bhi, level)
        own = alo == blo
        grown = []
        for first, second, step, wanted in (
            ((alo, amid), (blo, bmid), 0, None), ((amid, ahi), (bmid, bhi), 0, None),
            ((alo, amid), (bmid, bhi), 1, None), ((amid, ahi), (blo, bmid), 1, ~own),
        ):
            ok = (first[1] > first[0]) & (second[1] > second[0]) & (bits + step <= budget)
            if wanted is not None:
                ok &= wanted
            grown.append((first[0][ok], first[1][ok], second[0][ok], second[1][ok], bits[ok] + step))
        stack.append((level + 1, *(np.concatenate(x) for x in zip(*grown))))
    root = _roots(links, n)
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def links(distinct: DataFrame, budget: int = 4) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of column ``fp`` that give the components of all links."""
    depth_of = {number: depth for number, depth, _, _ in _file(np.zeros(1, dtype=np.uint64), budget)}

    def file(batches):
        for batch in batches:
            fp = batch.column(0)
            values = fp.to_numpy(zero_copy_only=False).view(np.uint64)
            for _, _, moved, key in _file(values, budget):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array((moved ^ np.uint64(1 << 63)).view(np.int64)), fp],
                    ["key", "leaf", "fp"],
                )

    filed = written(distinct.select("fp").mapInArrow(file, "key bigint, leaf bigint, fp bigint"), "tries")
    # Written, so that both sides of the join are shuffled for it and Spark may split a crowded node's partition.
    crowded = written(
        filed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED)
        .select("key", F.ceil(F.col("n") / CROWDED).cast("int").alias("parts")),
        "crowded-nodes",
    )
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.expr("filter(sequence(0, parts - 1), p -> p != part)"))
    dealt = filed.join(crowded, "key", "left")
    alone = dealt.where("parts is null").select("key", F.lit(-1).alias("i"), F.lit(-1).alias("j"), "leaf", "fp")
    cells = (
        dealt.where("parts is not null").withColumn("part", part).withColumn("other", other)
        .select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "leaf", "fp")
    )
    cells = alone.unionByName(cells).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "leaf")

    def join(batches):
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]))
                size += batch.num_rows
            if size >= 1 << 16:
                rows = np.concatenate(held, axis=1)
                last = (rows[:3] != rows[:3, -1:]).any(axis=0)
                done = int(last.nonzero()[0][-1]) + 1 if last.any() else 0
                if done:
                    yield from _joined(rows[:, :done], depth_of, budget)
                held, size = [rows[:, done:]], rows.shape[1] - done
        if size:
            yield from _joined(np.concatenate(held, axis=1), depth_of, budget)

    return cells.mapInArrow(join, "a bigint, b bigint").distinct()


def _joined(rows: np.ndarray, depth_of: dict[int, int], budget: int):
    numbers = rows[0] >> 40
    for number in np.unique(numbers):
        key, i, j, leaf, fp = rows[:, numbers == number]
        changed = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        node = np.concatenate([[0], np.cumsum(changed)])
        a, b = trie_forest(leaf.view(np.uint64) ^ np.uint64(1 << 63), node, depth_of[int(number)], budget)
        yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, budget: int = 4
) -> DataFrame:
    """(doc_id, text_key, fingerprint, component_id) of every row."""
    prints = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    grouped = components(links(distinct, budget))
    named = distinct.join(grouped, distinct.fp == grouped.node, "left").select(
        "fp", "least_id", F.coalesce("component", "fp").alias("component")
    )
    lowest = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    labels = named.join(lowest, "component").select("fp", "component_id")
    return prints.join(labels, "fp").select(
        "doc_id", "text_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def without_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, budget: int = 4
) -> DataFrame:
    """The documents that bear their group's smallest id, with their own columns only; a group without any id stays whole."""
    found = near_duplicates(docs, id_col, text_col, width, budget)
    return without(docs, found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))), id_col, text_col)
