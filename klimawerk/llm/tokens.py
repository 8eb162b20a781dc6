"""Token counts of whole texts without token ids.

A tokenizer of word pieces splits a text into pre-tokens and each pre-token into pieces, so a text's count is the sum of its
pre-tokens' counts. The pieces of each distinct pre-token of the corpus are counted once by the tokenizer library, and joined
to the pre-token frequencies of the documents. The most frequent pre-tokens (at most ``HEAD``, by how often they occur) are
joined by broadcast, all others by a shuffle.

Texts are cut as the tokenizer file says: its special strings first, each one token as the library does by default, then
normalisation and the pre-token pattern. Texts of plain Latin letters and ASCII are cut by that pattern directly, each distinct
blank-separated word once, all others by the library's own normaliser and pre-tokenizer; both give the same pre-tokens.

Defined results: a null text is an empty one and has no bytes and no tokens. Repeated rows are counted alike, each on its own.
Null ids are kept. An empty table gives an empty result. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klimawerk.llm.storage import least_step, written

HEAD = 1 << 17
MEMO = 100_000
TOGETHER = 1_000
LIMIT = 2048

_SIMPLE = re.compile(r"[\t\n\r\x20-\x7E\xA0-įı-ſ‐-‧€]*+")
"""Characters that normalisation to NFC leaves alone and whose lower case is one character."""


def _vocabulary(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


class Cutter:
    """Cuts texts into the pre-tokens of a tokenizer file."""

    def __init__(self, definition: bytes):
        # Spark runs tasks side by side; threads inside one would only take more memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(definition)
        rules = json.loads(definition)
        special = [t for t in rules["added_tokens"] if t["special"] and not t["normalized"]]
        if len(special) != len(rules["added_tokens"]) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in special):
            raise ValueError("only plain special tokens are supported")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in special)) if special else None
        steps = [s["type"] for s in rules["normalizer"]["normalizers"]]
        split = rules["pre_tokenizer"]["pretokenizers"][0]
        direct = (
            steps == ["NFC", "Replace", "Lowercase"] and split["type"] == "Split" and split["behavior"] == "Removed"
            and split["invert"] and r"[\p{L}]+" in split["pattern"]["Regex"]
        )
        self.pattern = regex.compile(split["pattern"]["Regex"]) if direct else None
        self.memo: dict[str, list[str]] = {}

    def of_word(self, word: str) -> list[str]:
        """Pre-tokens of a blank-separated word; letters only are one."""
        if word.isalpha():
            return [word]
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = self.memo[word] = self.pattern.findall(word)
        return found

    def add(self, text: str, words: Counter, others: Counter) -> int:
        """Count a text's blank-separated words, or its pre-tokens if they can't be had from its words; its special tokens."""
        special, parts = 0, [text]
        if self.special is not None:
            parts = self.special.split(text)
            special = len(parts) - 1
        for part in parts:
            if self.pattern is not None and _SIMPLE.fullmatch(part):
                words.update(part.lower().split())
            elif part:
                normal = self.tokenizer.normalizer.normalize_str(part)
                others.update(normal[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal))
        return special

    def cut(self, words: Counter, others: Counter) -> Counter:
        """How often each pre-token occurs, given what ``add`` has counted."""
        for word, n in words.items():
            for pre_token in self.of_word(word):
                others[pre_token] = others.get(pre_token, 0) + n
        return others

    def __call__(self, text: str) -> tuple[int, Counter]:
        """Number of special tokens, and the pre-tokens of all else with their frequencies."""
        words, others = Counter(), Counter()
        special = self.add(text, words, others)
        return special, self.cut(words, others)

    def pieces(self, pre_tokens: list[str]) -> list[int]:
        """Pieces of each pre-token, by the library: many of them as one text, which cuts into the same pre-tokens."""
        out: list[int] = []
        for at in range(0, len(pre_tokens), TOGETHER):
            part = pre_tokens[at:at + TOGETHER]
            owner = self.tokenizer.encode(" ".join(part), add_special_tokens=False).word_ids
            count = Counter(owner)
            if len(count) == len(part) == max(owner, default=-1) + 1:
                out += [count[i] for i in range(len(part))]
            else:
                out += [len(e.ids) for e in self.tokenizer.encode_batch(part, add_special_tokens=False)]
        return out


def _cut_by(definition: bytes) -> Callable[[], Cutter]:
    return lambda: Cutter(definition)


def _texts(docs: DataFrame, text_col: str, *more) -> DataFrame:
    return docs.select(*more, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def distinct_pieces(docs: DataFrame, text_col: str, vocabulary: str) -> DataFrame:
    """(pre_token, times, pieces): each distinct pre-token once, with how often it occurs."""
    cut_by = _cut_by(_vocabulary(vocabulary))
    fields = ["pre_token", "times"]

    def found(batches):
        cutter = cut_by()
        words, others = Counter(), Counter()

        def flushed():
            cut = cutter.cut(words, others)
            out = pa.RecordBatch.from_arrays([pa.array(cut.keys(), pa.string()), pa.array(cut.values(), pa.int64())], fields)
            words.clear()
            others.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                cutter.add(text.as_py(), words, others)
                if len(words) + len(others) >= MEMO:
                    yield flushed()
        yield flushed()

    def count(batches):
        cutter = cut_by()
        for batch in batches:
            pieces = cutter.pieces(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, pa.int32())], [*fields, "pieces"])

    spread = _texts(docs, text_col).mapInArrow(found, "pre_token string, times bigint")
    distinct = spread.groupBy("pre_token").agg(F.sum("times").alias("times"))
    return written(distinct.mapInArrow(count, "pre_token string, times bigint, pieces int"), "pieces")


def token_counts(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, head: int = HEAD
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    pieces = distinct_pieces(docs, text_col, vocabulary)
    step = F.floor(F.log2("times") * 8)
    frequent = step >= least_step(pieces, step, head)
    rows = pieces.where(frequent).select("pre_token", "pieces").toArrow()  # at most ``head`` rows
    shared = docs.sparkSession.sparkContext.broadcast(dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())))
    cut_by = _cut_by(_vocabulary(vocabulary))
    rest_type = pa.list_(pa.struct([("pre_token", pa.string()), ("n", pa.int32())]))

    def sum_head(batches):
        cut, known = cut_by(), shared.value
        for batch in batches:
            sums, names, times, limits = [], [], [], [0]
            for text in batch.column(2):
                words, others = Counter(), Counter()
                total = cut.add(text.as_py(), words, others)
                for word, n in words.items():
                    count = known.get(word)  # a pre-token cuts into itself
                    if count is None:
                        for pre_token in cut.of_word(word):
                            others[pre_token] = others.get(pre_token, 0) + n
                    else:
                        total += count * n
                for pre_token, n in others.items():
                    count = known.get(pre_token)
                    if count is None:
                        names.append(pre_token)
                        times.append(n)
                    else:
                        total += count * n
                sums.append(total)
                limits.append(len(names))
            rest = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(times, pa.int32())], fields=list(rest_type.value_type))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(3), pa.array(sums, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(limits, pa.int32()), rest).cast(rest_type),
                ],
                ["row", "doc_id", "n_bytes", "head", "rest"],
            )

    source = _texts(
        docs, text_col, F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id")
    ).withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    # Written once: the row numbers are then the same for all that follows.
    counted = written(
        source.mapInArrow(sum_head, "row bigint, doc_id bigint, n_bytes bigint, head bigint, rest array<struct<pre_token: string, n: int>>"),
        "pre-tokens",
    )
    rest = counted.select("row", F.explode("rest").alias("p")).select("row", "p.*")
    others = rest.join(pieces.where(~frequent).select("pre_token", "pieces"), "pre_token").groupBy("row").agg(
        F.sum(F.col("n").cast("bigint") * F.col("pieces")).alias("others")
    )
    n_tokens = F.col("head") + F.coalesce("others", F.lit(0).cast("bigint"))
    return counted.select("row", "doc_id", "n_bytes", "head").join(others, "row", "left").select(
        "doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit")
    )
