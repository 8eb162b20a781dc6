"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib

import pytest

from llm_fixtures import make_docs, no_docs, odd_docs  # noqa: F401
from klimawerk.llm import archives, exact, language, mixing, simhash, substring, suffixes, tokens, toxicity, winnowing
from klimawerk.session import fresh_folder

EMPTY = hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [(7, "alpha BETA gamma delta epsilon zeta eta theta iota kappa"), (8, "zeta eta"), (9, None), (10, " "), (None, "theta iota"),
         (8, "zeta eta")],
        "item_id bigint, text string",
    )


def test_substring(odd_docs, no_docs):
    assert substring.repeated_units(no_docs).count() == 0
    found = substring.repeated_units(odd_docs).collect()
    # The line stays in the rows of id -5, which is the smallest; rows of one id do not remove each other's.
    assert sorted((r.doc_id is None, r.doc_id or 0, r.keep_id) for r in found if r.end <= 90) == [
        (False, 1, -5), (False, 2, -5), (True, 0, -5)]
    assert substring.without_repeats(odd_docs).count() == odd_docs.count()


def test_suffixes(odd_docs, no_docs):
    assert suffixes.repeated_spans(no_docs).count() == 0
    found = suffixes.repeated_spans(odd_docs, min_words=10, window=5).collect()
    assert {r.doc_id for r in found} == {None, 1, 2, 6, -5}
    assert {(r.start_word, r.end_word) for r in found if r.doc_id == 1} == {(0, 15)}
    assert {(r.start_word, r.end_word) for r in found if r.doc_id == 6} == {(0, 80_000)}


def test_toxicity(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None), (77, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(odd_docs, labels)
    found = toxicity.scored(odd_docs, model).collect()
    assert len(found) == odd_docs.count()
    assert all(0 <= r.score <= 1 for r in found) and all(r.held_out for r in found if r.doc_id is None)
    assert toxicity.scored(no_docs, model).count() == 0
    empty = toxicity.fit(no_docs, labels.limit(0))
    assert {r.score for r in toxicity.scored(odd_docs, empty).collect()} == {0.0}
    assert toxicity.without_toxic(odd_docs, labels.limit(0)).columns == odd_docs.columns


def test_token_counts(odd_docs, no_docs):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    assert tokens.token_counts(no_docs, path).count() == 0
    found = tokens.token_counts(odd_docs, path).collect()
    assert len(found) == odd_docs.count()
    assert {(r.n_bytes, r.n_tokens) for r in found if r.doc_id in (3, 4)} == {(0, 0)}
    assert {r.over_limit for r in found if r.doc_id == 6} == {True}


def test_exact(odd_docs, no_docs):
    assert exact.exact_duplicates(no_docs).count() == 0
    found = exact.exact_duplicates(odd_docs).collect()
    assert len(found) == odd_docs.count()
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    # Of six equal texts the one with a blank more is longest; of the blank ones, that of three characters.
    assert (by_id[1].keep_id, by_id[1].group_size, by_id[1].kept) == (2, 5, False)
    assert (by_id[3].keep_id, by_id[3].group_size, by_id[3].text_sha256) == (5, 4, EMPTY)
    assert sum(r.kept for r in found) == len({r.text_sha256 for r in found})
    kept = exact.without_duplicates(odd_docs)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5, 6, 7, 8, 1 << 62]
    assert kept.columns == odd_docs.columns


def test_exact_keeps_what_ties(make_docs):
    found = exact.exact_duplicates(make_docs([(None, "a b", None, None), (9, "ab ", None, None), (4, " ab", None, None)])).collect()
    assert {r.keep_id for r in found} == {4}
    alone = exact.exact_duplicates(make_docs([(None, "a", None, None)])).first()
    assert (alone.keep_id, alone.kept) == (None, True)


def test_exact_index_takes_batches(make_docs, spark):
    index = exact.DigestIndex.temporary(spark, buckets=4)
    first = index.ingest(make_docs([(1, "one", None, None), (2, "two", None, None), (3, "o ne", None, None)])).collect()
    assert {r.doc_id: (r.keep_id, r.kept) for r in first} == {1: (3, False), 2: (2, True), 3: (3, True)}
    second = index.ingest(make_docs([(0, "on e  ", None, None), (5, "five", None, None)])).collect()
    assert {r.doc_id: (r.keep_id, r.kept, r.group_size) for r in second} == {0: (3, False, 3), 5: (5, True, 1)}
    assert index.rows().count() == 3
    assert exact.DigestIndex(spark, index.path, 4).rows().count() == 3
    plan = index.rows().groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan  # rows are bucketed by digest
    index.compact()
    assert index.rows().count() == 3 and len(index.rows().inputFiles()) <= 4
    assert exact.DigestIndex(spark, index.path).buckets == 4
    again = index.ingest(make_docs([(6, "o n e", None, None), (7, "six", None, None)])).collect()
    assert {r.doc_id: (r.keep_id, r.kept) for r in again} == {6: (3, False), 7: (7, True)}


def test_exact_index_has_a_file_for_each_bucket(make_docs, spark, monkeypatch):
    """Into whatever number of partitions rows are dealt, a batch adds one file to a bucket and makes no compaction needed."""
    docs = make_docs([(i, f"text {i}", None, None) for i in range(400)], clash=False)
    deal = type(docs).repartition
    monkeypatch.setattr(type(docs), "repartition", lambda self, n, *cols: deal(self, max(n, 90) if cols and isinstance(n, int) else n, *cols))
    index = exact.DigestIndex.temporary(spark, buckets=4)
    assert index.ingest(docs).where("kept").count() == 400
    assert index.generation == 0 and len(index.rows().inputFiles()) <= 4 and index.rows().count() == 400


def test_exact_index_of_another_application(make_docs, spark):
    """A session whose catalog does not know the index takes it up by its folder and loses no row."""
    path = fresh_folder(spark, "test-index")
    first = exact.DigestIndex(spark, path, 4)
    first.ingest(make_docs([(1, "one", None, None), (2, "two", None, None)])).collect()
    first.close()
    assert not spark.catalog.tableExists(first.name)
    second = exact.DigestIndex(spark.newSession(), path)
    found = second.ingest(make_docs([(8, "o ne", None, None), (9, "nine", None, None)])).collect()
    assert {r.doc_id: (r.keep_id, r.kept, r.group_size) for r in found} == {8: (1, False, 2), 9: (9, True, 1)}
    assert {r.keep_id for r in second.rows().collect()} == {1, 2, 9}


def test_exact_keeps_one_row_of_an_id(make_docs):
    rows = [(7, "a b", None, None), (7, "ab", None, None), (None, "c", None, None), (None, "c", None, None), (7, "a b", None, None)]
    found = exact.exact_duplicates(make_docs(rows)).collect()
    assert sorted((r.doc_id or 0, r.group_size) for r in found if r.kept) == [(0, 2), (7, 3)]
    assert sorted(r.text for r in exact.without_duplicates(make_docs(rows)).collect()) == ["a b", "c"]


def test_exact_leaves_no_table_in_the_catalog(make_docs, spark):
    exact.exact_duplicates(make_docs([(1, "a", None, None)])).collect()
    before = {t.name for t in spark.catalog.listTables()}
    exact.without_duplicates(make_docs([(1, "a", None, None)])).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_mixing(odd_docs, no_docs):
    assert mixing.mixture(no_docs).count() == 0
    assert mixing.mixed_blocks(no_docs).count() == 0
    found = mixing.mixture(odd_docs).collect()
    assert len(found) == odd_docs.count()
    assert {r.taken for r in found if r["size"] == 0} == {0}
    assert all(r.taken <= 3 * r["size"] for r in found)
    assert {r.source for r in found} == {"a", "b", "é", None}
    assert mixing.mixed_blocks(odd_docs).count() > 0


def test_simhash(odd_docs, no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    found = simhash.near_duplicates(odd_docs).collect()
    assert len(found) == odd_docs.count()
    assert {(r.fingerprint, r.component_id) for r in found if r.doc_id in (3, 4, 5)} == {("0" * 16, 3)}
    assert {r.component_id for r in found if r.doc_id in (1, 2, -5)} == {-5}
    kept = simhash.without_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and {-5, 3, 6} <= {r.doc_id for r in kept.collect()}


def test_language(odd_docs, no_docs, make_docs):
    untaught = language.fit(no_docs)
    assert {(r.lang_pred, r.score) for r in language.identified(odd_docs, untaught).collect()} == {("und", 0.0)}
    tables = language.fit(odd_docs)
    assert language.identified(no_docs, tables).count() == 0
    found = language.identified(odd_docs, tables).collect()
    assert len(found) == odd_docs.count()
    assert {r.lang_pred for r in found if r.doc_id in (3, 4, 5)} == {"und"}
    assert {r.lang_pred for r in found if r.doc_id not in (3, 4, 5, None)} <= {"en", "de"}
    digits = language.identified(make_docs([(1, "123 !?", None, None), (2, "\U00020000", None, None)]), tables).collect()
    assert {r.doc_id: r.lang_pred == "und" for r in digits} == {1: True, 2: False}


def test_winnowing(odd_docs, no_docs, items):
    assert winnowing.contamination(no_docs, items).count() == 0
    found = winnowing.contamination(odd_docs, items).collect()
    assert len(found) == odd_docs.count()
    named = hashlib.sha256(b",7,8").hexdigest()
    assert {(r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in found if r.doc_id in (1, 2, -5)} == {(15, 10, 3, named)}
    assert {(r.n_words, r.n_hit, r.items_sha256) for r in found if r.doc_id in (3, 4, 5)} == {(0, 0, EMPTY)}
    none = winnowing.contamination(odd_docs, items.limit(0)).collect()
    assert {r.contaminated for r in none} == {False}
    kept = winnowing.without_contaminated(odd_docs, items)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 4, 5, 6, 7, 8, 1 << 62]


def test_archives(spark):
    pages = spark.createDataFrame(
        [(3, "http://a/ b", "same"), (1, None, "same"), (2, "http://c", None), (None, "http://d", ""), (None, "http://e", "only"),
         (None, "http://e", "only"), (5, "http://f", "x" * 200_000), (6, "http://g", "line\r\n\r\nWARC/1.0\r\nend\n"), (1, None, "same")],
        "page_id bigint, url string, html string",
    )
    found = archives.archived(pages).collect()
    assert len(found) == 9
    expected = {
        (3, 4, "revisit", 1), (1, 4, "response", None), (2, 0, "response", None), (None, 0, "revisit", 2), (None, 4, "response", None),
        (None, 4, "revisit", None), (5, 200_000, "response", None), (6, 22, "response", None),
    }
    assert {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in found} == expected
    assert {r.payload_digest for r in found if r.page_id == 2} == {archives.payload_digest(b"")}
    assert archives.archived(pages.limit(0)).count() == 0


def test_converted_archives_name_their_version_block_and_open_at_any_record(spark):
    import gzip
    import zlib

    # Names that the operator uses inside.
    pages = spark.range(40).selectExpr(
        "id AS page_id", "'http://a' AS url", "repeat('p', int(id)) AS html", "'clash' AS archive", "1 AS number", "'clash' AS path",
        "2 AS least", "'clash' AS digest", "'clash' AS revisits",
    ).repartition(3)
    folder = archives.convert(spark, archives.write_arc(pages))
    paths = [r.path for r in archives._archives(spark, folder).collect()]
    assert paths and all(p.endswith(".warc.gz") for p in paths)
    n = 0
    for path in paths:
        system, at = archives._place(path)
        data, kinds = system.open_input_stream(at, compression=None).read(), []
        while data:  # every gzip member is one whole record
            member = zlib.decompressobj(31)
            (header, block), = archives.read_warc(gzip.io.BytesIO(member.decompress(data) + member.flush()))
            kinds.append(header["warc-type"])
            if kinds[-1] == "warcinfo":
                info = header["warc-record-id"]
                version = archives.http_field(block, "arc-version")
                assert f" {version} 0 generator\r\n {' '.join(archives.ARC_FIELDS[version])}\r\n".encode() in block
            else:
                assert header["warc-warcinfo-id"] == info
            data = member.unused_data
        assert kinds[0] == "warcinfo" and "warcinfo" not in kinds[1:]
        n += len(kinds) - 1
    assert n == 40
    assert archives.warc_records(spark, folder).count() == 40


def test_arc_versions_and_faults():
    import io

    for version in ("1", "2"):
        data = archives.arc_block("x", version) + archives.arc_record(4, "http://a", "<p>", version, "x")
        (number, fields, body), = archives.read_arc(io.BytesIO(data))
        assert (number, fields["URL"], fields["Archive-length"]) == (0, "http://a", str(len(body)))
        assert archives.split_http(body)[1] == b"<p>"
        with pytest.raises(ValueError, match="declared"):
            list(archives.read_arc(io.BytesIO(data[:-3])))
    with pytest.raises(ValueError, match="version block"):
        list(archives.read_arc(io.BytesIO(archives.arc_record(4, "http://a", "", "1", "x"))))
    binary = archives._arc_record("http://b", "1.2.3.4", "image/png", b"\xff\x00\n\xfe", "1", "x")
    (_, _, body), = archives.read_arc(io.BytesIO(archives.arc_block("x", "1") + binary))
    assert body == b"\xff\x00\n\xfe"
