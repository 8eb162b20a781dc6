"""Ranked search against scoring every document."""

import collections
import math
import re

from llm_fixtures import CLASHES, LONG, SMALL, make_docs, no_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F

from klimawerk.llm import ranking
from klimawerk.llm.queries import QUERIES
from klimawerk.llm.storage import table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute_force(docs, items, k):
    """(item_id, rank, doc_id, score) of (id, text) rows; equal scores by id, null last."""
    counted = [(i, collections.Counter(terms(t))) for i, t in docs if terms(t)]
    df = collections.Counter(t for _, c in counted for t in c)
    total, length = len(counted), sum(sum(c.values()) for _, c in counted)
    out = []
    for item, text in items:
        scores = []
        for doc, c in counted:
            m = 100 - 75 + 75 * sum(c.values()) * total // length
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in terms(text) if t in c
            )
            if score:
                scores.append((-score, doc is None, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_equals_scoring_every_document(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    assert found(QUERIES["op12_ranking"](spark, SMALL)) == brute_force(docs, items, 10)


def test_common_words_ties_and_many_terms(spark, make_docs):
    """Items of one term and of a thousand, a word that is in every document, equal scores across the k-th place."""
    docs = [(i, f"the word{i % 40} {'the ' * (i % 3)}pair{i % 2} rare{i}", "en", "a") for i in range(300)]
    items = [(1, "the"), (2, "word3"), (3, "pair1 the the"), (4, " ".join(f"rare{i}" for i in range(900))), (5, "none"), (6, "word3 word4 rare4 the")]
    df = spark.createDataFrame(items, "item_id bigint, text string")
    got = found(ranking.ranked_documents(make_docs(docs), df, k=5))
    assert got == brute_force([(i, t) for i, t, _, _ in docs], items, 5)


def test_odd_rows(spark, odd_docs, no_docs):
    items = [(1, "Alpha XI größer"), (1, "Alpha XI größer"), (2, None), (3, ""), (4, LONG + " nul"), (None, "日本語 x"), (5, "omicron")]
    df = spark.createDataFrame(items, "item_id bigint, text string").withColumns({n: F.lit("clash") for n in CLASHES if n != "row"})
    docs = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert found(ranking.ranked_documents(odd_docs, df)) == brute_force(docs, items, 10)
    assert ranking.ranked_documents(no_docs, df).collect() == []
    assert ranking.ranked_documents(odd_docs, df.limit(0)).collect() == []
