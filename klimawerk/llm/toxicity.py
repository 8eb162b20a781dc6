"""Toxicity by multiple-instance learning: labels of documents, scores of sentences.

A sentence's score is logistic in its words and in the beginnings of its words, which stand for inflected forms; a document's score is the noisy-or of its sentences, ``1 - prod(1 - p)``. The
weights are fitted to document labels, so no sentence needs a label, and the sentences that carry a document's score can be
named afterwards.

The classifier is fitted on a bounded sample: about ``sample_docs`` labelled documents, chosen by a hash of the id, and the
``max_words`` words and beginnings that go with the labels most, of those that occur in ``min_docs`` of them and differ from
chance by ``LEAST_Z`` deviations. Scoring reads every whole text.

Defined results: a null or empty text has no sentences; its score is that of a document in which nothing was found. A null
id cannot be labelled and counts as held out. Of several labels for one id the highest holds; null labels are ignored.
Without labels of both kinds every score is the share of toxic labels (0 without any). Repeated rows are scored alike. An
empty table gives an empty result. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from klimawerk.llm.storage import least_step, written
from klimawerk.llm.text import NOT_ALNUM, chunks, prefix_hashes, word_hashes, words

SAMPLE_DOCS = 12_000
MAX_WORDS = 1 << 16
MIN_DOCS = 5
LEAST_Z = 3.0
BEGINNINGS = (4, 5, 6)
FOLDS = 5

_STOP = np.isin(np.arange(256), list(b".!?\n"))


class Model(NamedTuple):
    """Sorted feature hashes with their weights; ``prior`` replaces all scores if nothing could be fitted."""

    vocabulary: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float | None


class Sentences(NamedTuple):
    """Sentences with a word: text, byte limits; and each distinct known word of each (sentence, word index)."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    sentence: np.ndarray
    word: np.ndarray


def held_out(id_col: str = "doc_id") -> Column:
    """Every fifth document by the checksum of its id."""
    checksum = F.crc32(F.col(id_col).cast("bigint").cast("string").cast("binary"))
    return F.coalesce(checksum % FOLDS == 0, F.lit(True))


def _split(texts: list[bytes]):
    """Words of the texts, the sentence of each word, first words of sentences; features and the word of each."""
    w = words([t.decode("utf-8").lower().encode("utf-8") for t in texts], NOT_ALNUM, lower=False)
    stops = np.concatenate([[0], np.cumsum(_STOP[np.frombuffer(w.data, dtype=np.uint8)])])
    mark = stops[w.start]
    new = np.ones(len(mark), dtype=bool)
    if len(mark) > 1:
        new[1:] = (mark[1:] != mark[:-1]) | (w.text[1:] != w.text[:-1])
    beginnings, owner = prefix_hashes(w, BEGINNINGS)
    hashes = np.concatenate([word_hashes(w), beginnings])
    return w, np.cumsum(new) - 1, np.flatnonzero(new), hashes, np.concatenate([np.arange(len(mark)), owner])


def _sentences(texts: list[bytes], vocabulary: np.ndarray) -> Sentences:
    w, sentence, begin, hashes, owner = _split(texts)
    last = np.append(begin[1:], len(sentence)) - 1 if len(begin) else begin
    if len(vocabulary):
        place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        known = vocabulary[place] == hashes
        pair = np.unique(sentence[owner[known]].astype(np.int64) << 20 | place[known])
    else:
        pair = np.zeros(0, dtype=np.int64)
    return Sentences(w.text[begin], w.start[begin], w.end[last] if len(begin) else begin, pair >> 20, pair & ((1 << 20) - 1))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def _scores(model: Model, s: Sentences, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Score of each sentence and of each of ``n`` texts."""
    if model.prior is not None:
        return np.full(len(s.text), model.prior), np.full(n, model.prior)
    z = model.bias + np.bincount(s.sentence, model.weight[s.word], minlength=len(s.text))
    clean = np.bincount(s.text, _softplus(z), minlength=n)  # minus the logarithm that no sentence is toxic
    return 1 / (1 + np.exp(-z)), -np.expm1(-clean)


def fit_arrays(
    label: np.ndarray, doc: np.ndarray, sentence: np.ndarray, word: np.ndarray, n_words: int, rounds: int = 100
) -> tuple[np.ndarray, float]:
    """Weights and bias from labels of documents; ``doc`` is the document of each sentence."""
    weight, bias = np.zeros(n_words), -5.0
    first, second = np.zeros(n_words + 1), np.zeros(n_words + 1)
    n = len(label)
    for step in range(1, rounds + 1):
        z = bias + np.bincount(sentence, weight[word], minlength=len(doc))
        clean = np.bincount(doc, _softplus(z), minlength=n)
        # Of the loss by the score before the logistic: p for label 0, -p / (exp(clean) - 1) for label 1.
        factor = np.where(label == 1, -1 / np.expm1(np.clip(clean, 1e-6, 50)), 1.0)
        slope = factor[doc] / (1 + np.exp(-z)) / n
        grad = np.append(np.bincount(word, slope[sentence], minlength=n_words) + 1e-5 * weight, slope.sum())
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        move = 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-5)
        weight, bias = weight - move[:-1], bias - move[-1]
    return weight, float(bias)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample_docs: int = SAMPLE_DOCS, max_words: int = MAX_WORDS, min_docs: int = MIN_DOCS,
) -> Model:
    """Fit on about ``sample_docs`` labelled documents that are not held out."""
    known = (
        labels.where(F.col(label_col).isNotNull() & ~held_out("doc_id"))
        .groupBy(F.col("doc_id").cast("bigint").alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__label"))
    )
    total, toxic = known.agg(F.count("*"), F.coalesce(F.sum("__label"), F.lit(0))).first()
    if not 0 < toxic < total:
        return Model(np.zeros(0, dtype=np.uint64), np.zeros(0), 0.0, toxic / total if total else 0.0)
    share = min(1.0, sample_docs / total)
    sample = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # About sample_docs rows of two numbers each, whatever the size of the tables.
    texts = docs.select(F.col(id_col).cast("bigint").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    labelled = texts.join(F.broadcast(sample), "__id").select("__label", "__text")
    total, toxic = labelled.agg(F.count("*"), F.coalesce(F.sum("__label"), F.lit(0))).first()
    if not 0 < toxic < total:
        return Model(np.zeros(0, dtype=np.uint64), np.zeros(0), 0.0, toxic / total if total else 0.0)
    vocabulary = _telling_words(labelled, toxic / total, max_words, min_docs)

    def parse(batches):
        for batch in batches:
            for begin, part in chunks(batch.column(1)):
                s = _sentences(part, vocabulary)
                count = np.bincount(s.text, minlength=len(part))
                owner = s.text[s.sentence]
                limits = np.searchsorted(owner, np.arange(len(part) + 1)).astype(np.int32)
                local = s.sentence - (np.cumsum(count) - count)[owner]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, len(part)), pa.array(count.astype(np.int32)),
                        pa.ListArray.from_arrays(limits, local.astype(np.int32)),
                        pa.ListArray.from_arrays(limits, s.word.astype(np.int32)),
                    ],
                    ["label", "sentences", "sentence", "word"],
                )

    # Of the sample, labels and the few telling words of each sentence reach the driver.
    rows = labelled.mapInArrow(parse, "label int, sentences int, sentence array<int>, word array<int>").toArrow().combine_chunks()
    count = rows.column("sentences").to_numpy().astype(np.int64)
    lists = [rows.column(c).combine_chunks() for c in ("sentence", "word")]
    first = np.cumsum(count) - count
    sentence = lists[0].flatten().to_numpy() + np.repeat(first, np.asarray(lists[0].value_lengths()))
    weight, bias = fit_arrays(
        rows.column("label").to_numpy(), np.repeat(np.arange(len(count)), count), sentence, lists[1].flatten().to_numpy(), len(vocabulary)
    )
    return Model(vocabulary, weight, bias, None)


def _telling_words(labelled: DataFrame, share: float, most: int, min_docs: int) -> np.ndarray:
    """Sorted hashes of the features that go with the label most, ``most`` at most."""
    def features(batches):
        for batch in batches:
            for begin, part in chunks(batch.column(1)):
                w, _, _, hashes, owner = _split(part)
                text = w.text[owner]
                order = np.lexsort((hashes, text))
                hashes, text = hashes[order], text[order]
                fresh = np.ones(len(hashes), dtype=bool)
                fresh[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
                label = batch.column(0).slice(begin, len(part)).take(pa.array(text[fresh]))
                yield pa.RecordBatch.from_arrays([pa.array(hashes[fresh].view(np.int64)), label], ["word", "label"])

    counted = labelled.mapInArrow(features, "word bigint, label int").groupBy("word").agg(
        F.count("*").alias("n"), F.sum("label").alias("toxic")
    )
    z = F.abs(F.col("toxic") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    telling = written(counted.where(F.col("n") >= min_docs).select("word", z.alias("z")).where(F.col("z") >= LEAST_Z), "telling-words")
    step = F.floor(F.col("z") * 16)
    words_ = telling.where(step >= least_step(telling, step, most)).select("word").toArrow()
    return np.sort(words_.column("word").to_numpy().view(np.uint64))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Score of the document's whole text, as a column of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    @F.pandas_udf("double")
    def toxicity(texts: pd.Series) -> pd.Series:
        out = [np.zeros(0)]
        own = Model(*shared.value)
        for _, part in chunks(pa.array(texts, pa.string())):
            out.append(_scores(own, _sentences(part, own.vocabulary), len(part))[1])
        return pd.Series(np.concatenate(out))

    return toxicity(F.col(text_col).cast("string"))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), held_out(id_col).alias("held_out"), score(docs, model, text_col).alias("score")
    )
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def offending_sentences(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5
) -> DataFrame:
    """(doc_id, sentence, score) of each sentence that scores ``least`` or more, lower-cased."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def find(batches):
        own = Model(*shared.value)
        for batch in batches:
            for begin, part in chunks(batch.column(1)):
                s = _sentences(part, own.vocabulary)
                p, _ = _scores(own, s, len(part))
                data = b" ".join(t.decode("utf-8").lower().encode("utf-8") for t in part) + b" "
                at = np.flatnonzero(p >= least)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(begin + s.text[at])),
                        pa.array([data[s.start[i]:s.end[i]].decode("utf-8") for i in at], pa.string()),
                        pa.array(p[at], pa.float64()),
                    ],
                    ["doc_id", "sentence", "score"],
                )

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(find, "doc_id bigint, sentence string, score double")


def without_toxic(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", reject_at: float = 0.5
) -> DataFrame:
    """The documents that score below ``reject_at``, with their own columns only."""
    model = fit(docs, labels, id_col, text_col)
    return docs.where(score(docs, model, text_col) < reject_at)
