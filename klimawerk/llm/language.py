"""Language identification by interpolated Kneser-Ney character models, one per language.

Texts become letters in lower case, each its own code point, with single spaces for all else. The four-letter grams of all
labelled training texts are counted; lower orders follow from them as continuation counts. A language's probability of a
letter after three others interpolates the four orders with absolute discounts. All grams and contexts stay in Spark tables
with one number per language. The ``HEAD`` most frequent grams are also held in an array sorted by gram hash, whose size does
not grow with the corpus, and looked up there by binary search; every other gram of a document is joined to the tables by a
shuffle, so none is left out. A text gets the language of least cross-entropy per letter.

The score is the language's share in a softmax of the negative cross-entropies, its sharpness fitted on all training texts;
from all of them each language also gets the cross-entropy that hardly any of its own texts exceeds, beyond which a text is
marked rejected. Bits are whole multiples of 2^-20 and losses of 10^-9, so sums do not depend on the order of rows.

Defined results: a null text, or one without letters, is ``und`` with score 0, rejected. Without training texts every text is.
A null label teaches nothing. A null id counts as held out. Of equal cross-entropies the first language in code-point order
holds. Repeated rows get equal results. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from klimawerk.llm.storage import least_step, written
from klimawerk.llm.text import chunks, mix

ORDER, BITS = 4, 21
HEAD = 1 << 21
"""Numbers in the array of frequent grams: for each gram its hash, context and letter, and one number per language."""
OWN_SHARE = 0.999
SHARPNESSES = [2.0 ** (i / 2) for i in range(-4, 14)]
FINE = 10
"""Steps of a cross-entropy, of 1 / SCALE, are counted by 2^FINE at first."""
FOLDS, HELD = 3, 1
UNKNOWN = "und"
SCALE = 1 << 20

_SPACE = 1


class Model(NamedTuple):
    """``shares(level, context, letter, share)`` and ``weights(level, context, weight)`` hold an array over ``names``."""

    names: list[str]
    shares: DataFrame
    weights: DataFrame
    first: list[float]
    head: dict
    sharpness: float
    limits: list[float]


def held_out(id_col: str = "doc_id") -> Column:
    checksum = F.crc32(F.col(id_col).cast("bigint").cast("string").cast("binary"))
    return F.coalesce(checksum % FOLDS == HELD, F.lit(True))


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTERS[0]


def uniform() -> float:
    """What a letter or space gets below the first order."""
    return 1 / (int(letters().sum()) + 1)


def _gram_stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each letter and space with the three before it (its context), the text of each, and the letters of each text."""
    lowered = [t.decode("utf-8").lower() for t in texts]
    code = np.frombuffer("".join(lowered).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    blank = ~letters()[code]
    count_letters = np.bincount(text[~blank], minlength=len(texts))
    # One space for each run of other characters between letters; before the first and after the last letter they come below.
    first = np.ones(len(code), dtype=bool)
    first[1:] = text[1:] != text[:-1]
    kept = ~blank
    kept[1:] |= blank[1:] & ~blank[:-1] & ~first[1:]
    at = np.flatnonzero(kept)
    last = np.ones(len(at), dtype=bool)
    last[:-1] = text[at[1:]] != text[at[:-1]]
    at = at[~(blank[at] & last)]
    code, text = np.where(blank[at], _SPACE, code[at]), text[at]
    count = np.bincount(text, minlength=len(texts))
    pad = ORDER - 1
    size = np.where(count > 0, count + pad + 1, 0)
    begin = np.concatenate([[0], np.cumsum(size)])
    stream = np.full(begin[-1], _SPACE, dtype=np.int64)
    inside = np.arange(len(code)) - np.repeat(np.cumsum(count) - count, count)
    stream[begin[text] + pad + inside] = code
    owner = np.repeat(np.arange(len(texts)), size)
    context = np.zeros(max(len(stream) - pad, 0), dtype=np.int64)
    for j in range(pad):
        context |= stream[j:j + len(context)] << (BITS * (pad - 1 - j))
    whole = owner[:len(context)] == owner[pad:]
    return context[whole], stream[pad:][whole], owner[:len(context)][whole], count_letters


def _keys(context: np.ndarray, letter: np.ndarray) -> np.ndarray:
    return mix(context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + letter.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    new = np.ones(len(sorted_keys[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return new


def gram_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, context, letter, n) over every given text."""
    fields = ["lang", "context", "letter", "n"]

    def count(batches):
        for batch in batches:
            for begin, texts in chunks(batch.column(1)):
                names, lang = np.unique(batch.column(0).slice(begin, len(texts)).to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
                context, letter, text, _ = _gram_stream(texts)
                own = lang[text]
                key = mix(_keys(context, letter) + own.astype(np.uint64))
                order = np.argsort(key)
                at = np.flatnonzero(_runs(key[order]))
                n, chosen = np.diff(np.append(at, len(order))), order[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.DictionaryArray.from_arrays(pa.array(own[chosen]), pa.array(names.tolist(), pa.string())).cast(pa.string()),
                        pa.array(context[chosen]), pa.array(letter[chosen].astype(np.int32)), pa.array(n, pa.int64()),
                    ],
                    fields,
                )

    source = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    spread = source.mapInArrow(count, "lang string, context bigint, letter int, n bigint")
    return spread.groupBy("lang", "context", "letter").agg(F.sum("n").alias("n"))


def _shorter(order: int) -> Column:
    """The part of a context that the given order looks at."""
    return F.col("context").bitwiseAND(F.lit((1 << (BITS * (order - 1))) - 1))


def _levels(counts: DataFrame) -> DataFrame:
    """(lang, level, context, letter, n): counts of order 4 and continuation counts of the orders below."""
    # Written once; each lower order would count the texts again.
    level = written(counts, "gram-counts").withColumn("level", F.lit(ORDER))
    all_levels = level
    for order in range(ORDER - 1, 0, -1):
        level = level.groupBy("lang", _shorter(order).alias("context"), "letter").agg(F.count("*").alias("n")).withColumn("level", F.lit(order))
        all_levels = all_levels.unionByName(level)
    return written(all_levels, "gram-levels")


def _by_language(names: list[str], value: Column, missing: float) -> Column:
    """Array over the languages, from rows of one language each."""
    each = [F.coalesce(F.max(F.when(F.col("lang") == name, value)), F.lit(missing)) for name in names]
    return F.array(*each) if each else F.array().cast("array<double>")


def _shares_and_weights(levels: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """What a gram has of its context in its own order, and what a context leaves to the order below."""
    contexts = levels.groupBy("lang", "level", "context").agg(F.sum("n").alias("total"), F.count("*").alias("types"))
    once = levels.groupBy("lang", "level").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"))
    discount = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(F.lit(0.5))
    contexts = contexts.join(once.select("lang", "level", discount.alias("discount")), ["lang", "level"])
    contexts = written(contexts, "gram-contexts")
    share = (F.col("n") - F.col("discount")) / F.col("total")
    shares = levels.join(contexts, ["lang", "level", "context"]).groupBy("level", "context", "letter").agg(
        _by_language(names, share, 0.0).alias("share")
    )
    weights = contexts.groupBy("level", "context").agg(
        _by_language(names, F.col("discount") * F.col("types") / F.col("total"), 1.0).alias("weight")
    )
    return written(shares, "gram-shares"), written(weights, "gram-weights")


def probabilities(grams: DataFrame, model: Model) -> DataFrame:
    """(context, letter, p) of each distinct gram: its probability under each language, by way of all orders."""
    needed = {ORDER: grams.select("context", "letter").distinct()}
    for order in range(ORDER - 1, 0, -1):
        needed[order] = needed[order + 1].select(_shorter(order).alias("context"), "letter").distinct()
    n = len(model.names)
    found = None
    for order in range(1, ORDER + 1):
        own = model.shares.where(F.col("level") == order).select("context", "letter", "share")
        rows = needed[order].join(own, ["context", "letter"], "left")
        if order == 1:
            weight = F.array(*[F.lit(w) for w in model.first])
            lower = F.array_repeat(F.lit(uniform()), n)
        else:
            below = found.select(F.col("context").alias("__context"), F.col("letter").alias("__letter"), F.col("p").alias("lower"))
            weights = model.weights.where(F.col("level") == order).select("context", "weight")
            rows = rows.join(weights, "context", "left").join(
                below, (_shorter(order - 1) == F.col("__context")) & (F.col("letter") == F.col("__letter"))
            )
            weight, lower = F.coalesce("weight", F.array_repeat(F.lit(1.0), n)), F.col("lower")
        share = F.coalesce("share", F.array_repeat(F.lit(0.0), n))
        left = F.zip_with(weight, lower, lambda w, p: w * p)
        found = rows.select("context", "letter", F.zip_with(share, left, lambda s, p: s + p).alias("p"))
    return found


def _bits(grams: DataFrame, model: Model) -> DataFrame:
    p = probabilities(grams, model)
    return p.select("context", "letter", F.transform("p", lambda x: F.round(-F.log2(x) * SCALE).cast("bigint")).alias("bits"))


def _head(counts: DataFrame, model: Model, numbers: int) -> dict:
    """The most frequent grams, sorted by hash: at most ``numbers`` numbers."""
    times = written(counts.groupBy("context", "letter").agg(F.sum("n").alias("times")), "gram-times")
    step = F.floor(F.log2("times") * 8)
    chosen = times.where(step >= least_step(times, step, numbers // (len(model.names) + 3))).select("context", "letter")
    rows = _bits(written(chosen, "head-grams"), model).toArrow()
    context, letter = rows.column("context").to_numpy(), rows.column("letter").to_numpy().astype(np.int64)
    bits = rows.column("bits").combine_chunks().flatten().to_numpy().reshape(-1, len(model.names))
    key = _keys(context, letter)
    order = np.argsort(key)
    return {"key": key[order], "context": context[order], "letter": letter[order], "bits": bits[order]}


def _sums(head: dict, texts: list[bytes], n_langs: int):
    """Bits of each text's frequent grams by language, its grams and letters; (text, context, letter, n) of all others."""
    context, letter, text, n_letters = _gram_stream(texts)
    key = _keys(context, letter)
    order = np.argsort(key)
    new = _runs(key[order])
    first, number = order[new], np.cumsum(new) - 1
    out = np.zeros((len(texts), n_langs), dtype=np.int64)
    hit = np.zeros(len(order), dtype=bool)
    if len(head["key"]):
        place = np.minimum(np.searchsorted(head["key"], key[first]), len(head["key"]) - 1)
        known = (head["key"][place] == key[first]) & (head["context"][place] == context[first]) & (head["letter"][place] == letter[first])
        hit = known[number]
        owner, row = text[order[hit]], place[number[hit]]
        for j in range(n_langs):
            out[:, j] = np.rint(np.bincount(owner, head["bits"][row, j], minlength=len(texts)))
    rest = order[~hit]
    rest = rest[np.lexsort((key[rest], text[rest]))]
    at = np.flatnonzero(_runs(key[rest], text[rest]))
    times, rest = np.diff(np.append(at, len(rest))), rest[at]
    return out, np.bincount(text, minlength=len(texts)), n_letters, (text[rest], context[rest], letter[rest], times)


def cross_entropies(docs: DataFrame, model: Model, text_col: str, **kept: Column) -> DataFrame:
    """The ``kept`` columns of each row, with usable, n (grams) and bits: an array over the languages, in steps of 1 / SCALE."""
    source = docs.select(
        F.monotonically_increasing_id().alias("row"), *[c.alias(name) for name, c in kept.items()],
        F.col(text_col).cast("string").alias("text"),
    )
    more = "usable boolean, n bigint, head array<bigint>, rest array<struct<context: bigint, letter: int, n: bigint>>"
    schema = StructType(source.schema.fields[:-1] + StructType.fromDDL(more).fields)
    shared, n_langs = docs.sparkSession.sparkContext.broadcast(model.head), len(model.names)
    gram = pa.struct([("context", pa.int64()), ("letter", pa.int32()), ("n", pa.int64())])

    def measure(batches):
        for batch in batches:
            for begin, texts in chunks(batch.column(batch.num_columns - 1)):
                sums, n, n_letters, (text, context, letter, times) = _sums(shared.value, texts, n_langs)
                others = pa.StructArray.from_arrays(
                    [pa.array(context, pa.int64()), pa.array(letter.astype(np.int32)), pa.array(times, pa.int64())], fields=list(gram)
                )
                limits = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)))])
                columns = [c.slice(begin, len(texts)) for c in batch.columns[:-1]] + [
                    pa.array(n_letters > 0), pa.array(n, pa.int64()), pa.array(sums.tolist(), pa.list_(pa.int64())),
                    pa.ListArray.from_arrays(pa.array(limits, pa.int32()), others).cast(pa.list_(gram)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "usable", "n", "head", "rest"])

    # Written once: the row numbers are then the same for all that follows.
    measured = written(source.mapInArrow(measure, schema), "gram-sums")
    rare = measured.select("row", F.explode("rest").alias("g")).select("row", "g.*")
    bits = written(_bits(written(rare.select("context", "letter").distinct(), "rare-grams"), model), "gram-bits")
    # Both sides of this join may be shuffled for it, so Spark may split the partition of a gram that is common here only.
    others = rare.join(bits, ["context", "letter"]).groupBy("row").agg(
        F.array(*[F.sum(F.col("n") * F.col("bits")[i]) for i in range(n_langs)]).alias("others")
    )
    total = F.when(F.col("others").isNull(), F.col("head")).otherwise(F.zip_with("head", "others", lambda a, b: a + b))
    return measured.select("row", *kept, "usable", "n", "head").join(others, "row", "left").select(*kept, "usable", "n", total.alias("bits"))


def _sharpness(measured: DataFrame, own: Column) -> float:
    """That of the softmax with the least loss over all given rows."""
    least = F.array_min("bits")

    def loss(sharpness: float) -> Column:
        scale = F.lit(sharpness / SCALE)
        total = F.aggregate(F.transform("bits", lambda b: F.exp((least - b) / F.col("n") * scale)), F.lit(0.0), lambda x, y: x + y)
        return F.round(((own - least) / F.col("n") * scale + F.log(total)) * 1e9).cast("decimal(20,0)")

    row = measured.agg(F.count("*").alias("rows"), *[F.sum(loss(c)).alias(str(i)) for i, c in enumerate(SHARPNESSES)]).first()
    best, sharpness = float("inf"), 1.0
    for i, candidate in enumerate(SHARPNESSES):
        mean = float(row[str(i)]) / 1e9 / row["rows"] if row["rows"] else 0.0
        if mean < best - 1e-9:
            best, sharpness = mean, candidate
    return sharpness


def _limits(measured: DataFrame, own: Column, names: list[str]) -> list[float]:
    """For each language the ``OWN_SHARE`` quantile of its own texts' cross-entropies, infinite without texts.

    Texts are counted by coarse steps, then by fine ones inside the coarse steps that hold the ranks sought, so the driver gets
    counts of a bounded number of steps.
    """
    steps = measured.select("lang", F.ceil(own / F.col("n")).cast("bigint").alias("step")).withColumn("coarse", F.shiftright("step", FINE))
    counts = steps.groupBy("lang", "coarse").agg(F.count("*").alias("n")).collect()
    sought: dict[str, list[tuple[int, int]]] = {}
    share = {}
    for name in names:
        mine = sorted((r["coarse"], r["n"]) for r in counts if r["lang"] == name)
        texts = sum(n for _, n in mine)
        if texts:
            low = int((texts - 1) * OWN_SHARE)
            share[name] = (texts - 1) * OWN_SHARE - low
            sought[name] = [_holding(mine, rank) for rank in (low, min(low + 1, texts - 1))]
    if not sought:
        return [float("inf")] * len(names)
    inside = F.lit(False)
    for name, places in sought.items():
        inside |= (F.col("lang") == name) & F.col("coarse").isin([at for at, _ in places])
    fine = steps.where(inside).groupBy("lang", "coarse", "step").agg(F.count("*").alias("n")).collect()
    limits = []
    for name in names:
        below, above = (
            _holding(sorted((r["step"], r["n"]) for r in fine if r["lang"] == name and r["coarse"] == at), rank)[0]
            for at, rank in sought[name]
        ) if name in sought else (float("inf"), float("inf"))
        limits.append((below + share[name] * (above - below)) / SCALE if name in sought else float("inf"))
    return limits


def _holding(counts: list[tuple[int, int]], rank: int) -> tuple[int, int]:
    """The value that holds a rank, and the rank among its rows."""
    for value, n in counts:
        if rank < n:
            return value, rank
        rank -= n
    raise ValueError("rank beyond the counts")


def _calibrated(model: Model, measured: DataFrame) -> Model:
    """With sharpness and limits from all usable rows of ``measured(lang, usable, n, bits)``."""
    measured = measured.where("usable")
    own = F.element_at("bits", F.array_position(F.array(*[F.lit(name) for name in model.names]), F.col("lang")).cast("int"))
    return model._replace(sharpness=_sharpness(measured, own), limits=_limits(measured, own, model.names))


def _training(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())


def _counted(training: DataFrame, text_col: str, lang_col: str, head: int) -> Model:
    """Model without calibration."""
    levels = _levels(gram_counts(training, text_col, lang_col))
    names = sorted(r["lang"] for r in levels.where("level = 1").select("lang").distinct().collect())  # languages
    shares, weights = _shares_and_weights(levels, names)
    first = weights.where("level = 1").first()
    model = Model(names, shares, weights, list(first["weight"]) if first else [], {}, 1.0, [])
    return model._replace(head=_head(levels.where(F.col("level") == ORDER), model, head)) if names else model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", head: int = HEAD) -> Model:
    """Models of all languages among the labelled documents that are not held out."""
    training = _training(docs, id_col, text_col, lang_col)
    model = _counted(training, text_col, lang_col, head)
    if not model.names:
        return model
    return _calibrated(model, written(cross_entropies(training, model, text_col, lang=F.col(lang_col).cast("string")), "training-bits"))


def fitted_and_identified(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", head: int = HEAD
) -> DataFrame:
    """``identified`` by a model of the same documents; the training texts are measured once for both."""
    model = _counted(_training(docs, id_col, text_col, lang_col), text_col, lang_col, head)
    if not model.names:
        return identified(docs, model, id_col, text_col)
    # A label is kept only where it may be learnt from; predictions do not read it.
    label = F.when(~held_out(id_col) & F.col(text_col).isNotNull(), F.col(lang_col).cast("string"))
    kept = {"doc_id": F.col(id_col).cast("bigint"), "held_out": held_out(id_col), "lang": label}
    measured = written(cross_entropies(docs, model, text_col, **kept), "all-bits")
    return _scored(measured, _calibrated(model, measured.where("lang IS NOT NULL")))


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row."""
    doc_id = F.col(id_col).cast("bigint")
    if not model.names:
        return docs.select(
            doc_id.alias("doc_id"), held_out(id_col).alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
            F.lit(True).alias("rejected"),
        )
    return _scored(cross_entropies(docs, model, text_col, doc_id=doc_id, held_out=held_out(id_col)), model)


def _scored(measured: DataFrame, model: Model) -> DataFrame:
    least = F.array_min("bits")
    best = F.array_position("bits", least).cast("int")
    excess = F.transform("bits", lambda b: F.exp((least - b) / F.col("n") * F.lit(model.sharpness / SCALE)))
    score = 1 / F.aggregate(excess, F.lit(0.0), lambda total, x: total + x)
    limit = F.element_at(F.array(*[F.lit(x) for x in model.limits]), best)
    return measured.select(
        "doc_id", "held_out",
        F.when(F.col("usable"), F.element_at(F.array(*[F.lit(x) for x in model.names]), best)).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(F.col("usable"), score).otherwise(F.lit(0.0)).alias("score"),
        F.when(F.col("usable"), least / F.col("n") / SCALE > limit).otherwise(F.lit(True)).alias("rejected"),
    )
