"""Search, condition trees and top-k over result tables."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def _not(met: Column) -> Column:
    """A missing value does not meet the plain condition, so it meets the negated one."""
    return ~F.coalesce(met, F.lit(False))


_CONDITIONS = {
    "=": lambda c, v: c == v[0],
    "!=": lambda c, v: _not(c == v[0]),
    "<": lambda c, v: c < v[0],
    "<=": lambda c, v: c <= v[0],
    ">": lambda c, v: c > v[0],
    ">=": lambda c, v: c >= v[0],
    "between": lambda c, v: c.between(v[0], v[1]),
    "!between": lambda c, v: _not(c.between(v[0], v[1])),
    "starts": lambda c, v: F.lower(c.cast("string")).startswith(v[0].lower()),
    "!starts": lambda c, v: _not(F.lower(c.cast("string")).startswith(v[0].lower())),
    "ends": lambda c, v: F.lower(c.cast("string")).endswith(v[0].lower()),
    "!ends": lambda c, v: _not(F.lower(c.cast("string")).endswith(v[0].lower())),
    "contains": lambda c, v: F.lower(c.cast("string")).contains(v[0].lower()),
    "!contains": lambda c, v: _not(F.lower(c.cast("string")).contains(v[0].lower())),
    "null": lambda c, v: c.isNull(),
    "!null": lambda c, v: c.isNotNull(),
}


def condition(tree: dict) -> Column:
    """Nested ``{"logic": "AND" | "OR", "criteria": [...]}`` with leaves ``{"column", "condition", "value"}``.

    The result is one ordinary predicate that Catalyst can push into the scan. A missing value meets ``null`` and the negated
    conditions, as an empty cell does, and no other.
    """
    if "criteria" not in tree:
        return _CONDITIONS[tree["condition"]](F.col(f"`{tree['column']}`"), tree.get("value", []))
    combine = operator.or_ if tree["logic"] == "OR" else operator.and_
    parts = [condition(t) for t in tree["criteria"]]
    return reduce(combine, parts) if parts else F.lit(True)


def search_builder(table: DataFrame, tree: dict) -> DataFrame:
    return table.filter(condition(tree))


def text_search(table: DataFrame, text: str) -> DataFrame:
    """Rows whose cells together contain every word of the text, in any case."""
    row_text = F.lower(F.concat_ws("  ", *[f"`{c}`" for c in table.columns]))
    return reduce(lambda t, word: t.filter(row_text.contains(word)), text.lower().split(), table)


def top_k(table: DataFrame, order: list[Column], k: int = 10, keys: list[str] | None = None) -> DataFrame:
    """First ``k`` rows in the given order, of each station or of the whole table.

    Per station, Spark keeps only the first ``k`` rows of a station in each task before the exchange.
    """
    if keys is None:
        keys = ["station_id"]
    if not keys:
        return table.orderBy(*order).limit(k)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return table.withColumn("Rang", rank).filter(F.col("Rang") <= k)
