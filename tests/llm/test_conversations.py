"""Prefix tries against plain Python over every prefix."""

import collections
import hashlib
import zlib

import pytest
from llm_fixtures import CLASHES, SMALL  # noqa: F401
from pyspark.sql import functions as F

from klimawerk.llm import conversations as trie
from klimawerk.llm.ranks import ranked, sums_before
from klimawerk.llm.storage import table


def sequences(rows):
    """conv -> [(role, text), ...] from (conv, turn, role, text); equal turn numbers by the digest that the operator states."""
    def order(r):
        role, text = r[2] or "", r[3] or ""
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
        return (r[1] is not None, r[1] or 0, digest[:32])
    out = collections.defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        out[r[0]].append((r[2] or "", r[3] or ""))
    return out


def rebuilt(own):
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c - 5 * int(c / 5))
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def nodes(convs):
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    saved, leaves = collections.Counter(), collections.Counter()
    for p, m in members.items():
        own = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += p not in children
    return sorted((
        min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
        hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p)).encode()).hexdigest(),
    ) for p, m in members.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(turns):
    return sorted(tuple(r) for r in trie.prefix_tree(turns).select(COLUMNS).collect())


@pytest.fixture(scope="module")
def make(spark):
    def make(rows):
        df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
        return df.withColumns({n: F.lit("clash") for n in [*CLASHES, "conv", "place", "id", "part", "k0", "t0"] if n not in ("conv_id", "turn")})
    return make


def test_given_conversations(spark):
    df = table(spark, SMALL, "conversations")
    expected = nodes(rebuilt(sequences([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])))
    assert found(trie.with_shared_heads(trie.numbered_turns(df))) == expected and len(expected) > 20


def test_odd_rows(make):
    rows = [
        (1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None), (1, 2, "a", "x"), (2, 5, "user", "first"), (2, 6, "", ""),
        (None, 0, "user", "nobody"), (-3, 1, "user", "größer 日本語"), (-3, 1, "b", "tie"), (0, 0, "user", "zero"), (7, 1, "user", ""),
        (1 << 62, 0, "user", "first"), (10, 0, "us", "erfirst"), (11, 3, "x" * 70_000, "long " * 50_000), (12, 0, "user", "first"),
    ]
    df = make(rows)
    assert found(trie.numbered_turns(df)) == nodes(sequences(rows))
    assert found(trie.with_shared_heads(trie.numbered_turns(df))) == nodes(rebuilt(sequences(rows)))
    empty = make([]) if rows is None else df.limit(0)
    assert found(trie.with_shared_heads(trie.numbered_turns(empty))) == []


def test_long_conversations_go_on_in_further_blocks(make):
    """Copies, branches inside and at the edge of blocks, and one conversation that holds half of all turns."""
    stem = [("user", f"turn {i}") for i in range(40)]
    convs = {100 + i: stem[:n] + tail for i, (n, tail) in enumerate([
        (40, []), (40, []), (40, []), (16, []), (16, [("a", "b")]), (8, [("a", "b")] * 9), (7, stem[8:20]), (24, stem[:17]), (1, []),
    ])}
    convs[99] = [("user", f"turn {i % 7}") for i in range(300)]
    df = make([(c, i, *t) for c, turns in convs.items() for i, t in enumerate(turns)])
    assert found(trie.numbered_turns(df)) == nodes(convs)


def test_ranks_and_sums_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr("klimawerk.llm.ranks.SPAN", 50)
    rows = [(1 if i % 10 else i, i % 997, i) for i in range(4000)]
    df = spark.createDataFrame(rows, "k bigint, o bigint, v bigint").repartition(7)
    got = ranked(df, "k", ["o", "v"], "test-ranks")
    expected, seen = [], collections.Counter()
    for k, o, v in sorted(rows):
        expected.append((k, o, v, seen[k]))
        seen[k] += 1
    assert sorted(tuple(r) for r in got.collect()) == expected
    sums = {(r.k, r.rank): r.s for r in sums_before(got, "k", "rank", {"v": "s"}, "test-sums").collect()}
    running = collections.Counter()
    for k, _, v, place in expected:
        assert sums[k, place] == running[k]
        running[k] += v
