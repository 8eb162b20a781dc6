"""All registered queries beside their SQL, and the shape of their plans."""

import pytest

from conftest import SMALL
from __spark_entry__ import entry
from oracle_check import compare, connect
from klimawerk.workload.catalog import QUERIES
from klimawerk.workload.oracle import ORACLE

ONE_ROW = {"geo_bbox", "src_loaded_total"}
ACTIONS_INSIDE = {"live_normalise_stream", "live_latest_stream"}


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, SMALL), duck, ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ACTIONS_INSIDE))
def test_plan_has_no_cross_join_and_no_python(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for operator in ("NestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert operator not in plan
    # Only results of one row end in a single task, after an aggregate in every task.
    assert "SinglePartition" not in plan or name in ONE_ROW


def test_every_query_has_sql_and_entry_runs(spark):
    assert set(QUERIES) == set(ORACLE)
    assert entry(spark).count() > 0


