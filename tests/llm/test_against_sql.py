"""Queries that SQL can express, compared with DuckDB on the given tables."""

import pytest

from llm_fixtures import SMALL, make_docs, no_docs, odd_docs  # noqa: F401
from klimawerk.llm.queries import QUERIES
from klimawerk.llm.sql import ORACLE
from oracle_check import compare, connect


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SMALL), connect(SMALL), ORACLE[name]) == []


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
