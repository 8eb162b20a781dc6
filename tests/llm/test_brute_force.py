"""Operators that SQL can't express, compared with plain Python over the whole small tables."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from llm_fixtures import SMALL, make_docs, no_docs, odd_docs  # noqa: F401
from klimawerk.llm import language, mixing, simhash, substring, suffixes, tokens, toxicity
from klimawerk.llm.queries import QUERIES
from klimawerk.llm.storage import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in table(spark, SMALL, "documents").collect()}


def rows(spark, name):
    return QUERIES[name](spark, SMALL).collect()


def test_substring_dedup(spark, docs):
    first, expected = {}, []
    for doc_id in sorted(docs):
        for start, end, line, digest in substring.units(docs[doc_id].text, substring.SENTENCE_BYTES):
            if digest in first:
                expected.append((doc_id, start, end, first[digest], line))
            first.setdefault(digest, doc_id)
    whole = {(i, line): end for i, start, end, _, line in expected if start == line}
    for i, start, end, _, line in expected:
        if start == line:
            whole[i, line] = max(whole[i, line], end)
    expected = {
        (i, s, e, k) for i, s, e, k, line in expected
        if not ((i, line) in whole and (s > line or e < whole[i, line]) and e <= whole[i, line])
    }
    found = {(r.doc_id, r.start, r.end, r.keep_id) for r in rows(spark, "op1_substring_dedup")}
    assert found == expected and len(found) > 20


def test_substring_removal_keeps_the_rest(make_docs):
    line = "this very line is in several documents"
    docs = make_docs([(2, f"new\n{line}\nend", None, None), (1, f"{line}\nmore", None, None), (3, None, None, None)])
    out = {r.doc_id: r.text for r in substring.without_repeats(docs).collect()}
    assert out == {1: f"{line}\nmore", 2: "new\n\nend", 3: None}


@pytest.mark.parametrize("line", ["all rights reserved.", "x", "\u6240\u6709\u6743\u5229\u5747\u4e88\u4fdd\u7559\u4e0d\u5f97\u590d\u5236"])
def test_short_lines_and_lines_without_blanks(make_docs, line):
    docs = make_docs([(i, f"document number {i}\n{line}\n", None, None) for i in range(20)])
    found = substring.repeated_units(docs).collect()
    assert sorted(r.doc_id for r in found) == list(range(1, 20)) and {r.end - r.start for r in found} == {len(line)}


def test_sentences_of_texts_without_blanks(make_docs):
    same = "\u6240\u6709\u6743\u5229\u5747\u4e88\u4fdd\u7559\u4e0d\u5f97\u590d\u5236\u6216\u518d\u53d1\u8868\u3002"
    docs = make_docs([(i, chr(0x4E00 + i) * 20 + "\u3002" + same, None, None) for i in range(5)])
    found = substring.repeated_units(docs).collect()
    assert sorted((r.doc_id, r.start, r.end) for r in found) == [(i, 21, 21 + len(same)) for i in range(1, 5)]


def test_suffix_spans_cover_all_repeats(spark, docs):
    n, head = suffixes.MIN_WORDS, suffixes.MIN_WORDS - suffixes.WINDOW + 1
    words = {i: WORD.findall(r.text) for i, r in docs.items()}

    def covered(size):
        grams = collections.Counter(tuple(w[p:p + size]) for w in words.values() for p in range(len(w) - size + 1))
        return {
            (i, q) for i, w in words.items() for p in range(len(w) - size + 1) if grams[tuple(w[p:p + size])] > 1
            for q in range(p, p + size)
        }

    found = rows(spark, "op2_suffix_dedup")
    spots = {(r.doc_id, q) for r in found for q in range(r.start_word, r.end_word)}
    assert covered(n) <= spots <= covered(head)
    assert min(r.n_words for r in found) >= n


def test_suffix_spans_of_a_hot_passage(make_docs):
    """One passage inside many different texts, at known places."""
    rng = np.random.default_rng(1)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for i in range(300):
        before, after = ([f"w{x}" for x in rng.integers(0, 1 << 40, rng.integers(0, 90))] for _ in range(2))
        texts.append((i, " ".join([*before, *passage, *after]), len(before)))
    docs = make_docs([(i, t, None, None) for i, t, _ in texts]).repartition(7)
    found = {r.doc_id: (r.start_word, r.end_word, r.first_id) for r in suffixes.repeated_spans(docs).collect()}
    assert found == {i: (at, at + 60, 0) for i, _, at in texts}


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    found = QUERIES["op3_toxicity"](spark, sf).collect()
    assert len(found) == table(spark, sf, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    unseen = [(labels[r.doc_id], r.predicted) for r in found if r.held_out and r.doc_id in labels]
    caught = np.mean([p for y, p in unseen if y == 1])
    wrong = np.mean([p for y, p in unseen if y == 0])
    assert caught > 0.8 and wrong < 0.01


def test_toxicity_names_the_sentence(make_docs, spark):
    clean = [(i, f"plain words number {i}. some other words here. and one more", None, None) for i in range(0, 120)]
    bad = [(i, f"plain words number {i}. you are a scoundrel. and one more", None, None) for i in range(200, 260)]
    labels = spark.createDataFrame([(r[0], int(r[0] >= 200)) for r in [*clean, *bad]], "doc_id bigint, toxic int")
    docs = make_docs([*clean, *bad])
    model = toxicity.fit(docs, labels)
    found = toxicity.offending_sentences(docs, model).collect()
    assert {r.doc_id for r in found} == {r[0] for r in bad}
    assert all("scoundrel" in r.sentence and "plain" not in r.sentence for r in found)


def test_token_counts_equal_the_library(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in rows(spark, "op4_token_counts"):
        text = docs[r.doc_id].text
        assert r.n_tokens == len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.over_limit) == (len(text.encode()), r.n_tokens > 2048)


def test_token_counts_of_odd_characters_and_a_small_head(make_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [
        "It's <|endoftext|> I'LL don''t <|ENDOFTEXT|>", "\x85a\x1cb c\xa0d", "İstanbul ΑΣ ς ﬁ é é 日本語 12³½ ١٢", "‘re '’",
        "'S 'Ve !'s ''s", "a​b﻿c \U0001F600", "ǅ ŉ ß ẞ K Å µ ſ", "<|startoftext|><|endoftext|>", "a\x00b\x7f\x1f c",
    ]
    docs = make_docs([(i, t, None, None) for i, t in enumerate(texts)])
    for head in (3, tokens.HEAD):
        found = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs, path, head=head).collect()}
        assert found == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_mixing_meets_its_targets(spark, docs):
    found = rows(spark, "op6_mixing")
    assert {r.doc_id: r["size"] for r in found} == {i: len(WORD.findall(r.text)) for i, r in docs.items()}
    assert all(0 <= r.taken <= 3 * r["size"] for r in found)
    by_source = collections.defaultdict(list)
    for r in found:
        by_source[r.source].append(r)
    ordered = sorted(by_source)
    expected = _targets([sum(r["size"] for r in by_source[s]) for s in ordered])
    assert sum(expected) == pytest.approx(sum(r["size"] for r in found))
    for source, target in zip(ordered, expected):
        group = by_source[source]
        assert all(r.target == pytest.approx(target) and r.source_size == sum(x["size"] for x in group) for r in group)
        assert sum(r.taken for r in group) == pytest.approx(target, abs=mixing.BLOCK_WORDS)
    again = rows(spark, "op6_mixing")
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))


def _targets(sizes):
    """The level at which all limited shares add up to the whole, found by halving."""
    low, high = 0.0, float(sum(sizes)) + 1
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(level * (i % 3 + 1), 3 * size) for i, size in enumerate(sizes)) < sum(sizes):
            low = level
        else:
            high = level
    return [min(high * (i % 3 + 1), 3 * size) for i, size in enumerate(sizes)]


@pytest.mark.parametrize("sizes", [[], [0], [10, 1000, 0], [100, 100], [1, 10, 100, 1000, 10_000, 7, 7, 7, 100_000, 3]])
def test_targets_share_the_excess(spark, sizes):
    given = spark.createDataFrame([(f"s{i:03d}", n) for i, n in enumerate(sizes)], "source string, size bigint")
    found = sorted(mixing.targets(given).collect())
    assert [(r.number, r.source, r.size) for r in found] == [(i, f"s{i:03d}", n) for i, n in enumerate(sizes)]
    assert [r.target for r in found] == pytest.approx(_targets(sizes))


def test_sources_are_ordered_by_code_point_and_null_is_last(spark):
    names = ["Z", "a", "", "\uffff", "\U0001F600", None, "é"]
    given = spark.createDataFrame([(n, 1) for n in names], "source string, size bigint")
    found = [r.source for r in mixing.targets(given).orderBy("number").collect()]
    assert found == [*sorted(n for n in names if n is not None), None]


def test_more_sources_than_a_driver_would_list(spark):
    n = 200_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('s', id) AS source", "repeat('w ', 1 + int(id % 3)) AS text")
    found = mixing.mixture(docs, block_words=1).selectExpr("sum(taken) AS taken", "sum(target) AS target", "count(*) AS n").first()
    assert found.n == n
    assert found.target == pytest.approx(2 * n, rel=1e-4) and found.taken == pytest.approx(2 * n, rel=0.25)


def test_permutations_hit_every_block_once():
    for n in (1, 2, 3, 100, 1025):
        out = mixing.permuted(np.arange(n), n, np.full(n, 7, dtype=np.uint64))
        assert sorted(out) == list(range(n))
    # Each index by its own size.
    n = np.array([1, 2, 2, 70_000, 3, 3, 3])
    out = mixing.permuted(np.array([0, 0, 1, 69_999, 0, 1, 2]), n, np.full(7, 7, dtype=np.uint64))
    assert sorted(out[1:3]) == [0, 1] and sorted(out[4:]) == [0, 1, 2] and 0 <= out[3] < 70_000


def test_shards_have_one_length_and_multinomial_source_counts(spark):
    plan = [(0, 500, 1500, 0), (1, 40_000, 40_000, 1500), (2, 7, 0, 41_500), (3, 9000, 20_500, 41_500)]
    sources = spark.createDataFrame(plan, "number bigint, blocks bigint, slots bigint, start bigint")
    slots = mixing.drawn_slots(sources, seed=3, shard_slots=1000).collect()
    by_shard = collections.defaultdict(list)
    for r in slots:
        by_shard[r.shard].append(r)
    assert sorted(by_shard) == list(range(62))
    assert all(sorted(r.position for r in group) == list(range(1000)) for group in by_shard.values())
    for number, blocks, n, _ in plan:
        own = [r for r in slots if r.number == number]
        assert sorted(r.draw for r in own) == list(range(n))
        for turn in range(-(-n // blocks)):  # no block twice in a pass
            drawn = [r.block for r in own if r.draw // blocks == turn]
            assert len(set(drawn)) == len(drawn) and all(0 <= b < blocks for b in drawn)
        # Counts of a shard scatter as draws do: the variance of each is n p (1 - p), times what the fixed totals leave.
        p = n / 62_000
        counts = np.array([sum(r.number == number for r in group) for group in by_shard.values()])
        assert counts.mean() == pytest.approx(1000 * p)
        if n:
            assert 0.5 < counts.var() / (1000 * p * (1 - p)) < 1.7
    assert [tuple(r) for r in sorted(slots)] == [tuple(r) for r in sorted(mixing.drawn_slots(sources, 3, 1000).collect())]


def test_mixed_blocks_hold_the_words(make_docs):
    docs = make_docs([(i, " ".join(f"d{i}w{j}" for j in range(10 * i)), None, "ab"[i % 2]) for i in range(1, 12)], clash=False)
    taken = {r.doc_id: r.taken for r in mixing.mixture(docs, block_words=16).collect()}
    counted = collections.Counter(
        int(w[1:w.index("w")]) for r in mixing.mixed_blocks(docs, block_words=16).collect() for w in r.text.split()
    )
    assert {i: n for i, n in taken.items() if n} == dict(counted)


def test_mix_follows_the_order_of_its_documents_by_content(make_docs):
    """Equal ids, and none: the layout of the table must not show in the mix."""
    rows = [(None if i % 3 else 7, f"w{i} " * (i % 5 + 1), None, "ab"[i % 2]) for i in range(60)]
    first, again = (
        sorted(map(tuple, mixing.mixed_blocks(make_docs(r, clash=False).repartition(n), block_words=4).drop("doc_ids").collect()))
        for r, n in ((rows, 2), (rows[::-1], 5))
    )
    assert first and first == again


def _fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = WORD.findall(lowered)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _groups(prints, budget):
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= budget:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_components(spark, docs):
    prints = {i: _fingerprint(r.text) for i, r in docs.items()}
    groups = _groups(prints, 4)
    found = rows(spark, "op7_simhash")
    assert {r.doc_id: int(r.fingerprint, 16) for r in found} == prints
    assert {r.doc_id: r.component_id for r in found} == groups


def test_trie_join_finds_every_link(spark, monkeypatch):
    """Fingerprints in tight clusters, with parts so small that clusters are dealt out in pairs of parts."""
    monkeypatch.setattr(simhash, "CROWDED", 40)
    monkeypatch.setattr(simhash, "FRONTIER", 64)
    rng = np.random.default_rng(3)
    values = set()
    for centre in rng.integers(0, 1 << 63, 12):
        for _ in range(60):
            flips = rng.choice(64, rng.integers(0, 9), replace=False)
            value = int(centre)
            for b in flips:
                value ^= 1 << int(b)
            values.add(value)
    values = sorted(values)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    links = simhash.links(spark.createDataFrame(signed, "fp bigint"), 4).collect()
    groups = _groups(dict(enumerate(values)), 4)
    number = {s[0]: i for i, s in enumerate(signed)}
    parent = {i: i for i in groups}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        a, b = number[r.a], number[r.b]
        assert (values[a] ^ values[b]).bit_count() >= 1
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert {i: find(i) for i in groups} == groups


def test_language_of_held_out_documents(spark, docs):
    found = rows(spark, "op8_language")
    assert len(found) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    unseen = [r for r in found if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in unseen]) > 0.95


def kneser_ney(texts, alphabet):
    """Plain interpolated Kneser-Ney: probability of a letter after three others, from one language's texts."""
    streams = []
    for text in texts:
        letters = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
        if letters:
            streams.append("   " + letters + " ")
    tables = {4: collections.Counter(s[i:i + 4] for s in streams for i in range(len(s) - 3))}
    for order in (3, 2, 1):
        tables[order] = collections.Counter(g[1:] for g in tables[order + 1])

    def p(gram):
        if not gram:
            return 1 / alphabet
        table = tables[len(gram)]
        n1, n2 = (sum(n == k for n in table.values()) for k in (1, 2))
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        same = [n for g, n in table.items() if g[:-1] == gram[:-1]]
        if not same:
            return p(gram[1:])
        return max(table[gram] - d, 0) / sum(same) + d * len(same) / sum(same) * p(gram[1:])

    return p


LANGUAGE_TEXTS = [
    (0, "Abab abba, abc!", "en", None), (1, "baab ab 12 cab", "en", None), (2, "abab held out", "en", None),
    (7, "bb a\u65e5\u672c\u8a9e", "ja", None), (8, "\u65e5\u672c \u672c\u8a9e\u65e5\u672c", "ja", None),
    (13, "aab b \U00020000\U00020001 b", "ja", None), (9, None, "en", None), (10, "abba", None, None),
]


def test_language_calibration_reads_every_training_text(make_docs):
    docs = make_docs([(i, f"{'abcdefghij'[i % 10]}{'klmnopq'[i % 7]} {chr(97 + i * i % 23)}ab" * (1 + i % 3), "xy"[i % 2], None) for i in range(9000)])
    model = language.fit(docs)
    training = docs.where(~language.held_out())
    measured = language.cross_entropies(training, model, "text", lang=F.col("lang")).collect()
    assert len(measured) > 4000
    for j, name in enumerate(model.names):
        own = [r.bits[j] / r.n / language.SCALE for r in measured if r.lang == name]
        assert model.limits[j] == pytest.approx(np.quantile(own, language.OWN_SHARE), abs=3e-6)
    label = [model.names.index(r.lang) for r in measured]
    entropy = np.array([[b / r.n / language.SCALE for b in r.bits] for r in measured])

    def loss(sharpness):
        z = -sharpness * (entropy - entropy.min(axis=1, keepdims=True))
        return (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(label)), label]).mean()

    assert loss(model.sharpness) == pytest.approx(min(loss(c) for c in language.SHARPNESSES), abs=1e-6)
    assert sorted(language.fitted_and_identified(docs).collect()) == sorted(language.identified(docs, model).collect())


@pytest.mark.parametrize("head", [0, 60, language.HEAD])
def test_kneser_ney_equals_brute_force(make_docs, head):
    """However few grams the head holds, all others come from the tables."""
    docs = make_docs(LANGUAGE_TEXTS)
    trained = [t for t in LANGUAGE_TEXTS if t[1] and t[2] and zlib.crc32(str(t[0]).encode()) % 3 != 1]
    model = language.fit(docs, head=head)
    alphabet = 1 + sum(chr(c).isalpha() for c in range(0x110000))
    assert model.names == sorted({t[2] for t in trained}) and len(model.names) == 2
    assert len(model.head["key"]) * (len(model.names) + 3) <= head
    by_language = [kneser_ney([t[1] for t in trained if t[2] == name], alphabet) for name in model.names]
    probes = make_docs([*LANGUAGE_TEXTS, (21, "zebra \u65e5 q", None, None), (22, "...", None, None)])
    found = language.cross_entropies(probes, model, "text", value=F.col("doc_id"), again=F.col("text")).collect()
    for r in found:
        letters = " ".join("".join(c if c.isalpha() else " " for c in (r.again or "").lower()).split())
        stream = "   " + letters + " "
        assert r.usable == bool(letters) and r.n == (len(letters) + 1 if letters else 0)
        for p, bits in zip(by_language, r.bits):
            expected = -sum(math.log2(p(stream[i:i + 4])) for i in range(len(stream) - 3)) if letters else 0
            assert bits / language.SCALE == pytest.approx(expected, abs=1e-4)
    assert len(found) == len(LANGUAGE_TEXTS) + 2


def test_kneser_ney_probabilities_sum_to_one(make_docs, spark):
    docs = make_docs([(i, t, "en", None) for i, t in enumerate(["abab abba", "baab ab", "bb a", "aab b"] * 3)], clash=False)
    model = language.fit(docs)
    codes = [1, ord("a"), ord("b"), ord("z")]
    contexts = [(1, 1, 1), (1, ord("a"), ord("b")), (ord("a"), ord("b"), ord("a")), (ord("q"),) * 3]
    packed = {(c[0] << 42) | (c[1] << 21) | c[2] for c in contexts}
    grams = spark.createDataFrame([(c, x) for c in packed for x in codes], "context bigint, letter int")
    found = {(r.context, r.letter): r.p[0] for r in language.probabilities(grams, model).collect()}
    for c in packed:
        seen = sum(found[c, x] for x in codes[:3])
        assert seen + found[c, ord("z")] * (int(language.letters().sum()) + 1 - 3) == pytest.approx(1.0)


def test_language_does_not_depend_on_the_head(spark, docs):
    table_ = table(spark, SMALL, "documents")
    few, all_ = (
        {r.doc_id: r for r in language.identified(table_, language.fit(table_, head=h)).collect()} for h in (700, language.HEAD)
    )
    assert few == all_ and len(few) == len(docs)


def test_bitmap_of_slots(spark):
    from klimawerk.llm.storage import slots_bitmap
    from klimawerk.llm.text import in_bitmap

    rows = spark.range(0, 5000, 1, 7).select(F.xxhash64("id").alias("h"))
    bitmap = slots_bitmap(rows, F.col("h"))
    hashes = np.array([r.h for r in rows.collect()]).view(np.uint64)
    assert in_bitmap(bitmap, hashes).all()
    assert int(np.bitwise_count(bitmap).sum()) == len(np.unique(hashes >> np.uint64(40)))
    assert not slots_bitmap(rows.limit(0), F.col("h")).any()
