"""Packing against the tokenizer library, id by id, and its patterns against their histogram."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm_fixtures import SMALL, make_docs, no_docs, odd_docs  # noqa: F401
from klimawerk.llm import packing
from klimawerk.llm.queries import QUERIES
from klimawerk.llm.storage import table

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [2]


def check_sequences(rows, size):
    """Gapless from 0, never longer than ``size``, and shorter only at powers of two."""
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= size and end & (end - 1) == 0
    return len(sequences)


def texts_of(rows):
    """The ids of every document, from its pieces in order."""
    out = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r.start):
        assert len(out[r.doc_id]) == r.start and len(r.ids) == 4 * r.length
        out[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    return out


def test_every_id_is_in_one_piece(spark):
    docs = table(spark, SMALL, "documents")
    rows = packing.packed(docs, PATH).collect()
    check_sequences(rows, packing.SIZE)
    found = texts_of(rows)
    assert found == {r.doc_id: expected_ids(r.text) for r in docs.collect()}
    digests = {(r.doc_id, r.start): (r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset) for r in QUERIES["op11_packing"](spark, SMALL).collect()}
    assert digests == {
        (r.doc_id, r.start): (r.length, zlib.crc32(r.ids), len(found[r.doc_id]), r.sequence_id, r.offset) for r in rows
    }


def test_small_sequences_cut_long_texts(make_docs):
    rng = random.Random(1)
    docs = make_docs([(i, " ".join(["word"] * rng.randint(0, 60)), "en", "a") for i in range(50)])
    rows = packing.packed(docs, PATH, size=16).collect()
    check_sequences(rows, 16)
    assert texts_of(rows) == {r.doc_id: expected_ids(r.text) for r in docs.select("doc_id", "text").collect()}


def test_odd_rows(odd_docs, make_docs, no_docs):
    texts = ["a <|endoftext|> b", "don't STOP 3.14", "ß İstanbul ﬁ é", "\x85 x\xa0y", "  ", "<|startoftext|>", "日本 語", "it's 'S"]
    docs = odd_docs.unionByName(make_docs([(100 + i, t, None, None) for i, t in enumerate(texts)]))
    rows = packing.packed(docs, PATH).collect()
    check_sequences(rows, packing.SIZE)
    given = docs.select("doc_id", "text").collect()
    assert sum(r.length for r in rows) == sum(len(expected_ids(r.text)) for r in given)
    once = collections.Counter(r.doc_id for r in given)
    alone = [r for r in rows if once[r.doc_id] == 1]
    assert texts_of(alone) == {r.doc_id: expected_ids(r.text) for r in given if once[r.doc_id] == 1}
    assert {r.doc_tokens for r in rows if r.doc_id == 4} == {1}
    assert packing.packed(no_docs, PATH).collect() == []


@pytest.mark.parametrize("histogram", [
    {4096: 3}, {1: 10**12}, {3000: 10**9, 1096: 10**9, 1: 7}, {2500: 10**6}, {n: 1 + n * n % 977 for n in range(1, 4097)}, {5: 1},
])
def test_patterns_hold_the_histogram(histogram):
    patterns = packing.shortest_pack_first(histogram)
    held = collections.Counter()
    for p in patterns:
        assert sum(n * k for n, k in p.held.items()) + p.gap == packing.SIZE and p.count > 0
        for length, times in p.held.items():
            held[length] += times * p.count
    assert held == histogram and len(patterns) <= 3 * len(histogram)
    where = packing.layout(patterns)
    length, rank = zip(*[(n, r) for n, c in histogram.items() for r in {0, c // 2, c - 1}])
    number, first, take, _, offset = packing.placed(where, np.array(length), np.array(rank))
    whole = collections.Counter()
    for i, k in zip(number.tolist(), take.tolist()):
        whole[i] += k
    assert [whole[i] for i in range(len(length))] == list(length) and (offset + take <= packing.SIZE).all()


def test_longest_first_into_the_emptiest_pack():
    assert sorted(packing.shortest_pack_first({6: 1, 5: 1, 2: 1, 1: 1}, 8), key=lambda p: min(p.held)) == [(1, {6: 1, 1: 1}, 1), (1, {5: 1, 2: 1}, 1)]
