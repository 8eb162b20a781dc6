"""The pipeline's near-copy stage, compared with the similarity of all pairs."""

from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from llm_fixtures import make_docs, no_docs, odd_docs  # noqa: F401
from klimawerk.llm import shingles
from klimawerk.llm.storage import table

MIDDLE = "/root/testdata/sf0.01"


def _sets(rows):
    out = {}
    for r in rows:
        words = (r.text or "").lower().split()
        out[r.doc_id] = {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}
    return out


def _least(sets):
    """Smallest id of each id's component."""
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@pytest.fixture(scope="module")
def expected(spark):
    docs = table(spark, MIDDLE, "documents")
    return docs, _least(_sets(docs.select("doc_id", "text").collect()))


def test_components_are_those_of_all_pairs(expected):
    """At least nine in ten documents that have a near copy with a smaller id are found, and no other."""
    docs, least = expected
    found = {r.doc_id: r.component_id for r in shingles.near_copies(docs).collect()}
    assert all(found[i] in (least[i], i) or least[found[i]] == least[i] for i in least)
    copies = [i for i in least if least[i] != i]
    assert sum(found[i] == least[i] for i in copies) >= 0.9 * len(copies) > 50


def test_shared_passage_gives_few_candidates(make_docs):
    """Two thousand otherwise different texts with one passage: comparisons grow with the texts, not with their pairs."""
    passage = " ".join(f"common{i}" for i in range(60))
    rows = [(i, " ".join(f"own{i}x{j}" for j in range(60)) + " " + passage, "en", "a") for i in range(2000)]
    texts = make_docs(rows, clash=False).selectExpr("doc_id AS node", "text")
    filed = shingles._filed(texts, shingles.WIDTH)
    assert shingles._neighbours(filed, None).count() <= 2 * len(rows)
    found = shingles.near_copies(make_docs(rows, clash=False))
    assert found.where("doc_id != component_id").count() == 0


def test_large_group_of_near_copies(make_docs):
    words = [f"word{i}" for i in range(200)]
    rows = [(i, " ".join([*words[:i % 190], f"new{i}", *words[i % 190 + 1:]]), "en", "a") for i in range(1500)]
    docs = make_docs(rows, clash=False)
    assert {r.component_id for r in shingles.near_copies(docs).collect()} == {0}


def test_stage_drops_near_copies_beyond_four_bits(spark, make_docs):
    words = [f"word{i}" for i in range(120)]
    rows = [(i, " ".join([*words[:5 * i], f"new{i}", *words[5 * i + 1:]]), "en", "a") for i in range(1, 20)]
    rows.append((0, " ".join(words), "en", "a"))
    kept = corpus_pipeline.drop_near_copies(spark, make_docs(rows), "")
    least = _least(_sets(make_docs(rows, clash=False).collect()))
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(set(least.values())) == [0]


def test_odd_and_no_rows(odd_docs, no_docs):
    assert shingles.near_copies(no_docs).collect() == []
    assert shingles.near_copies(odd_docs).count() == odd_docs.count()
    assert shingles.without_near_copies(odd_docs).columns == odd_docs.columns


def test_no_link_at_the_threshold_is_lost(make_docs):
    """Twelve thousand pairs of similarity 0.8: bands alone miss about one in three thousand of them."""
    words = [[f"w{i}x{j}" for j in range(13)] for i in range(12000)]
    rows = [(2 * i + k, " ".join([*w[:12], w[12] + "y" * k]), "en", "a") for i, w in enumerate(words) for k in (0, 1)]
    found = shingles.near_copies(make_docs(rows, clash=False))
    assert {r.doc_id for r in found.where("component_id = doc_id").collect()} == {2 * i for i in range(12000)}


def test_groups_are_exactly_those_of_all_pairs(expected):
    docs, least = expected
    assert {r.doc_id: r.component_id for r in shingles.near_copies(docs).collect()} == least


def test_shared_passage_brings_no_pairs_to_the_exact_join(spark, make_docs):
    passage = " ".join(f"common{i}" for i in range(60))
    rows = [(i, " ".join(f"own{i}x{j}" for j in range(60)) + " " + passage, "en", "a") for i in range(2000)]
    texts = make_docs(rows, clash=False).selectExpr("doc_id AS node", "text")
    assert shingles._prefixes(texts, shingles.WIDTH, shingles.PERCENT).count() == 0


@pytest.mark.parametrize("parts", [1, 2])
def test_pairs_that_pass_the_sketch(parts):
    """All alike pairs of different groups pass, whatever the chunks; the closest of two groups alone is one of them."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = sorted((np.unique(np.concatenate([base[rng.random(400) < 0.94], rng.integers(0, 1 << 63, 20, dtype=np.uint64)])) for _ in range(600)), key=len)
    node, group = rng.permutation(600), rng.integers(0, 30, 600)
    part, size = np.arange(600) % parts, np.array([len(s) for s in sets])
    bits = np.frombuffer(b"".join(shingles.sketch(s) for s in sets), dtype=np.uint64).reshape(600, -1)
    near = {
        (min(node[x], node[y]), max(node[x], node[y])) for x, y in combinations(range(600), 2)
        if group[x] != group[y] and (parts == 1 or part[x] != part[y]) and shingles.alike(sets[x], sets[y], 80)
    }
    found = set(zip(*(c.tolist() for c in shingles.across(node, group, part, size, bits, 80, False))))
    assert near <= found and near
    closest = set(zip(*(c.tolist() for c in shingles.across(node, group, part, size, bits, 80, True))))
    assert closest <= found and len(closest) <= 30 * 29 / 2


def test_fine_sketches_drop_large_texts_that_share_a_passage_only(spark, make_docs):
    """Two large texts with few words in common go, two that are alike stay, and small ones are left to the whole sets."""
    def words(name, n):
        return [f"{name}{i}" for i in range(n)]

    rows = [
        (0, " ".join(words("a", 3000)), "en", "a"), (1, " ".join(words("a", 1200) + words("b", 1800)), "en", "a"),
        (2, " ".join(words("a", 2900) + words("c", 100)), "en", "a"), (3, "one two", "en", "a"), (4, "three four", "en", "a"),
    ]
    sketches = shingles._sketches(make_docs(rows, clash=False).selectExpr("doc_id AS node", "text"), shingles.WIDTH)
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (3, 4), (0, 3)], "a bigint, b bigint")
    left = {(r.a, r.b) for r in shingles._sieved(pairs, sketches, shingles.PERCENT).collect()}
    assert left == {(0, 2), (3, 4), (0, 3)}


def test_large_texts_that_share_a_passage_leave_no_bucket_as_pairs(spark, make_docs):
    """Their short sketches let all of these 780 pairs pass; the fine ones are looked at before a pair is made."""
    rng = np.random.default_rng(3)
    shared = " ".join(f"s{i}" for i in range(400))
    texts = [f"{shared} " + " ".join(f"w{rng.integers(1 << 40)}" for _ in range(2000)) for _ in range(40)]
    docs = make_docs([(i, text, "en", "a") for i, text in enumerate(texts)], clash=False).selectExpr("doc_id as node", "text")
    shared = shingles.written(docs.select(shingles.F.lit(7).cast("bigint").alias("h"), "node"), "test-shared")
    sketches = shingles._sketches(docs, shingles.WIDTH)
    grouped = spark.createDataFrame([], "node bigint, component bigint")
    pairs = shingles._apart(shared, sketches, grouped, shingles.PERCENT, False, None)
    rows = pairs.collect()
    assert rows == []
    loose = shingles._apart(shared, sketches.withColumn("fine", shingles.F.lit(None).cast("binary")), grouped, shingles.PERCENT, False, None)
    assert loose.count() > 700


def test_links_that_are_stars_take_no_round(spark):
    """Neither stars nor no links need a round; a chain does, and one pass more would not change it."""
    from klimawerk.llm.components import components

    stars = spark.createDataFrame([(5, 1), (1, 7), (9, 2)], "a bigint, b bigint")
    assert sorted(map(tuple, components(stars, max_rounds=1).collect())) == [(1, 1), (2, 2), (5, 1), (7, 1), (9, 2)]
    assert components(stars.where("a < 0"), max_rounds=1).collect() == []
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint")
    assert sorted(map(tuple, components(chain).collect())) == [(i, 0) for i in range(41)]
    with pytest.raises(RuntimeError):
        components(chain, max_rounds=1)


def test_components_are_read_without_an_exchange(spark):
    """The table of ends is the result; links given twice or in both directions change nothing."""
    from klimawerk.llm.components import components

    rng = np.random.default_rng(7)
    pairs = [tuple(map(int, p)) for p in rng.integers(-300, 300, (260, 2))]
    least = {n: n for p in pairs for n in p if p[0] != p[1]}
    for _ in least:
        for a, b in pairs:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    links = spark.createDataFrame(pairs + [p[::-1] for p in pairs[:50]] + pairs[:50] + [(1, None)], "a bigint, b bigint")
    found = components(links)
    assert dict(map(tuple, found.collect())) == least and found.count() == len(least)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
