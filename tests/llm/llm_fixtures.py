import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
LONG = "word one two three " * 20_000

# Names that the operators use inside.
CLASHES = [
    "row", "digest", "fp", "score", "text_key", "size", "key", "at", "prints", "number", "block", "__id", "__key", "__label",
    "component", "first", "head", "rest", "kept", "held_out", "gram", "shard", "url2", "archive", "value", "h", "spans",
]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text, lang, source), with columns whose names clash."""
    def make(rows, clash=True):
        df = spark.createDataFrame(
            [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows],
            "doc_id bigint, text string, lang string, source string, n_chars bigint",
        )
        return df.withColumns({name: F.lit("clash") for name in CLASHES}) if clash else df

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    text = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron."
    return make_docs([
        (1, text, "en", "a"), (1, text, "en", "a"), (2, text + " ", None, None), (3, "", "en", "a"), (4, None, "en", None),
        (5, " \n\t ", None, "b"), (None, text, "en", "b"), (None, None, None, None), (6, LONG, "en", "a"), (7, "x", "de", "b"),
        (8, "größer Straße 日本語 \U0001F600", "de", "é"), (1 << 62, "\x00\x1f nul", "en", "b"), (-5, text, "en", "a"),
    ])


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
