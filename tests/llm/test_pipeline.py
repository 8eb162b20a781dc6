"""The pipeline's stages, each judged on what the one before has kept."""

import corpus_pipeline
from llm_fixtures import SMALL, make_docs, no_docs, odd_docs  # noqa: F401
from klimawerk.llm import exact, mixing, shingles, toxicity, winnowing
from klimawerk.llm.storage import table, written


def test_every_stage_takes_effect(spark):
    docs = table(spark, SMALL, "documents")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], SMALL), f"test-{name}"))
    ids = [sorted(r.doc_id for r in df.select("doc_id").collect()) for df in kept[:-1]]
    assert all(df.columns == docs.columns for df in kept[:-1])

    model = toxicity.fit(docs, table(spark, SMALL, "labels"))
    assert ids[1] == sorted(r.doc_id for r in toxicity.scored(docs, model).where("predicted = 0").collect())
    assert ids[2] == sorted(r.doc_id for r in exact.exact_duplicates(kept[1]).where("kept").collect())
    assert ids[3] == sorted(r.doc_id for r in shingles.near_copies(kept[2]).where("doc_id = component_id").collect())
    found = winnowing.contamination(kept[3], table(spark, SMALL, "benchmark"))
    assert ids[4] == sorted(r.doc_id for r in found.where("not contaminated").collect())
    words = sum(len(r.text.split(" ")) for r in kept[5].select("text").collect())
    assert words == mixing.mixture(kept[4]).selectExpr("sum(taken) AS n").first().n
    assert len(ids[0]) > len(ids[1]) > len(ids[2]) > len(ids[4]) > 50
    assert sorted(map(str, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(str, kept[5].collect()))


def test_odd_rows_and_an_empty_corpus_run_through(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        kept = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, kept = kept, written(stage(spark, kept, SMALL), f"odd-{name}")
            assert kept.columns == docs.columns and kept.exceptAll(before).count() == 0
        mix = corpus_pipeline.STAGES[-1][1](spark, kept, SMALL)
        assert (mix.count() > 0) == (kept.count() > 0)
