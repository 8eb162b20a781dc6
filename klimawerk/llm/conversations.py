"""Prefix trie of conversations: which beginnings do conversations share, and what does sharing them save.

The turns of a conversation get digests and places, and go into rows of ``BLOCK`` positional columns. One ``ROLLUP`` over these
columns, with ``grouping_id`` as depth, aggregates all prefixes inside a block together; a long conversation goes on in a
further block, keyed by the node that its prior block ends in. That node's key is a sum of digests of (place, turn) over the
prefix, so all blocks of all conversations, however long, are rolled up by the same job.

Subtrees need no walk either. Each node is owned by its smallest member, and a member that is not the owner owns nothing above
the node. So a subtree's sum is the sum over its members of what each owns at all, by a second ``ROLLUP`` of the same
kind, less what the node's owner owns above the node.

Hot keys: places are counted over a global sort (``ranks.ranked``), so a conversation of any length is spread over tasks; first
turns and copies that very many conversations share are combined before every exchange. The digest of a node's ending members
needs all their ids in order; sorted tasks join them to long strings first, and one task streams these through the digest.

Defined results: rows without conv_id belong to no conversation and are left out. Null role or text becomes empty. Turns are
ordered by turn, null first, turns of one number by their digests; a repeated row is another turn. No rows give no node.
Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klimawerk.llm.ranks import ranked, sums_before
from klimawerk.llm.storage import written

BLOCK = 8
GROUP, HEADS = 5, 9
JOINED = 1 << 16
"""Characters of joined ids that are handed on as one row."""

_KEY = ["k0", "k1", "k2", "k3"]
_PRIOR = ["p0", "p1", "p2", "p3"]
_PARENT = ["q0", "q1", "q2", "q3"]
_SLOTS = [f"t{i}" for i in range(BLOCK)]


def _spot(i: int, place: str, turn: str) -> str:
    """A part of the digest of a turn at its place; the four parts have 32 bits each, so sums of them can't overflow."""
    return f"shiftrightunsigned(xxhash64({i}, {turn}, CAST({place} AS BIGINT)), 32)"


def numbered_turns(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv, place, id): places from 0; ``id`` is the digest of role and text, followed by the text's length in bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).cast("bigint").alias("turn"),
        F.concat(F.substring(digest, 1, 32), F.hex(F.octet_length(text))).alias("id"),
    )
    return ranked(turns, "conv", [F.asc_nulls_first("turn"), F.asc("id")], "turns").select(
        "conv", F.col("rank").alias("place"), "id"
    )


def with_shared_heads(turns: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """The first turns of the first conversation of each group of ids in place of a conversation's own first ones.

    (conv, place, id) as given, and one row without id per conversation, so that one without turns is known too.
    """
    own = turns.groupBy("conv").agg(F.count("*").alias("n"))
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(heads))
    plan = own.select("conv", (F.col("conv") - F.col("conv") % group).alias("base"), h.alias("h"))
    held = own.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    head = F.least("h", F.coalesce("base_n", F.lit(0)))
    # Written, so that both sides of the next joins are shuffled for them and Spark may split a long conversation.
    plan = written(plan.join(held, "base", "left").select("conv", "base", "h", head.alias("head")), "plan")
    firsts = turns.where(F.col("place") < heads).select(F.col("conv").alias("base"), "place", "id")
    given = plan.join(firsts, "base").where("place < h").select("conv", "place", "id")
    rest = turns.join(plan, "conv").where("place >= h").select("conv", (F.col("place") - F.col("h") + F.col("head")).alias("place"), "id")
    return given.unionByName(rest).unionByName(_bare(plan))


def _bare(convs: DataFrame) -> DataFrame:
    return convs.select("conv", F.lit(0).cast("bigint").alias("place"), F.lit(None).cast("string").alias("id"))


def _blocks(turns: DataFrame) -> DataFrame:
    """(conv, block, t0.., k0.., p0..): the turns of a block, the sums of their digests, and those of all turns before it."""
    slots = [f"max(CASE WHEN pmod(place, {BLOCK}) = {i} THEN id END) AS {s}" for i, s in enumerate(_SLOTS)]
    sums = [f"coalesce(sum(CASE WHEN id IS NOT NULL THEN {_spot(i, 'place', 'id')} END), 0) AS {k}" for i, k in enumerate(_KEY)]
    rows = turns.sparkSession.sql(
        f"SELECT conv, place DIV {BLOCK} AS block, {', '.join(slots + sums)} FROM {{turns}} GROUP BY conv, place DIV {BLOCK}",
        turns=turns,
    )
    return written(sums_before(rows, "conv", "block", dict(zip(_KEY, _PRIOR)), "blocks"), "prefixes")


def _rolled(rows: DataFrame, **aggregates: str) -> DataFrame:
    """One row per node with its key, its parent's key, its depth, the bytes of its last text, and the aggregates given as SQL."""
    slots, prior = ", ".join(_SLOTS), ", ".join(_PRIOR)
    last = f"element_at(array({slots}), greatest(e, 1))"
    spots = [
        " + ".join(f"CASE WHEN e > {j} THEN {_spot(i, f'block * {BLOCK} + {j}', s)} ELSE 0 END" for j, s in enumerate(_SLOTS))
        for i in range(len(_KEY))
    ]
    keys = ", ".join(f"{p} + {spot} AS {k}" for p, spot, k in zip(_PRIOR, spots, _KEY))
    parents = ", ".join(
        f"CASE WHEN depth > 0 THEN {k} - {_spot(i, 'depth - 1', 'last')} END AS {q}" for i, (k, q) in enumerate(zip(_KEY, _PARENT))
    )
    # A conversation that ends inside the block has no turn at deeper levels; a block's first node is the last one of the prior.
    return rows.sparkSession.sql(
        f"""
        WITH rolled AS (
          SELECT block, {prior}, {slots}, {BLOCK} - bit_count(grouping_id()) AS e,
                 {", ".join(f"{sql} AS {name}" for name, sql in aggregates.items())}
          FROM {{rows}} GROUP BY block, {prior}, ROLLUP({slots})
        ),
        node AS (
          SELECT {keys}, block * {BLOCK} + e AS depth, CASE WHEN e > 0 THEN {last} END AS last, {", ".join(aggregates)}
          FROM rolled WHERE CASE WHEN e = 0 THEN block = 0 ELSE {last} IS NOT NULL END
        )
        SELECT {", ".join(_KEY)}, {parents}, depth,
               CASE WHEN depth > 0 THEN CAST(conv(substr(last, 33), 16, 10) AS BIGINT) ELSE 0 END AS n_bytes, {", ".join(aggregates)}
        FROM node""",
        rows=rows,
    )


def _endings(blocks: DataFrame) -> DataFrame:
    """(k0.., ends_sha256): the digest of the ids that end in a node, by the node's key."""
    ends = blocks.groupBy("conv").agg(*[F.sum(k).alias(k) for k in _KEY]).select(*_KEY, "conv")

    def runs(batches):
        """Batches of lists: rows of equal key, in order."""
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            begin = 0
            for at in range(1, batch.num_rows + 1):
                if at == batch.num_rows or any(columns[i][at] != columns[i][begin] for i in range(4)):
                    yield tuple(columns[i][begin] for i in range(4)), [c[begin:at] for c in columns[4:]]
                    begin = at

    def out(rows, names):
        types = [pa.int64()] * 4 + [pa.int64()] * (len(names) - 5) + [pa.string()]
        columns = [list(c) for c in zip(*rows)] or [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def join(batches):
        key, parts, size, rows = None, [], 0, []
        for new, (convs,) in runs(batches):
            for begin in range(0, len(convs), 4096):
                if parts and (new != key or size >= JOINED):
                    rows.append((*key, parts[0], ",".join(map(str, parts))))
                    parts, size = [], 0
                key = new
                parts += convs[begin:begin + 4096]
                size += 20 * len(convs[begin:begin + 4096])
            if len(rows) >= 256:
                yield out(rows, [*_KEY, "first", "ids"])
                rows = []
        if parts:
            rows.append((*key, parts[0], ",".join(map(str, parts))))
        yield out(rows, [*_KEY, "first", "ids"])

    def digest(batches):
        key, state, rows = None, None, []
        for new, (_, ids) in runs(batches):
            if new != key:
                if state is not None:
                    rows.append((*key, state.hexdigest()))
                key, state, begun = new, hashlib.sha256(), False
            for part in ids:
                state.update((("," if begun else "") + part).encode())
                begun = True
            if len(rows) >= 4096:
                yield out(rows, [*_KEY, "ends_sha256"])
                rows = []
        if state is not None:
            rows.append((*key, state.hexdigest()))
        yield out(rows, [*_KEY, "ends_sha256"])

    fields = ", ".join(f"{k} bigint" for k in _KEY)
    joined = ends.repartitionByRange(*_KEY, "conv").sortWithinPartitions(*_KEY, "conv").mapInArrow(join, f"{fields}, first bigint, ids string")
    return joined.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(digest, f"{fields}, ends_sha256 string")


def prefix_tree(turns: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    ``turns(conv, place, id)`` as of ``numbered_turns`` or ``with_shared_heads``.
    """
    blocks = _blocks(turns)
    found = written(_rolled(blocks, n_convs="count(*)", conv_id="min(conv)"), "nodes")
    children = found.where("depth > 0").groupBy(*_PARENT).agg(F.count("*").alias("n_children"))
    nodes = found.join(children.withColumnsRenamed(dict(zip(_PARENT, _KEY))), _KEY, "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0).cast("bigint")),
        "own_saved": (F.col("n_convs") - 1) * F.col("n_bytes"),
        "own_leaf": F.col("n_children").isNull().cast("bigint"),
    })
    nodes = sums_before(nodes, "conv_id", "depth", {"own_saved": "saved_above", "own_leaf": "leaves_above"}, "owned")
    nodes = written(nodes, "named-nodes")
    owned = written(
        nodes.groupBy(F.col("conv_id").alias("conv")).agg(F.sum("own_saved").alias("saved"), F.sum("own_leaf").alias("leaves")),
        "owners",
    )
    below = _rolled(blocks.join(owned, "conv"), saved="sum(saved)", leaves="sum(leaves)").select(*_KEY, "saved", "leaves")
    parents = written(nodes.select(*[F.col(k).alias(q) for k, q in zip(_KEY, _PARENT)], F.col("conv_id").alias("parent_conv_id")), "parents")
    nothing = hashlib.sha256().hexdigest()
    return nodes.join(below, _KEY).join(_endings(blocks), _KEY, "left").join(parents, _PARENT, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaves") - F.col("leaves_above")).alias("n_leaves"), (F.col("saved") - F.col("saved_above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
