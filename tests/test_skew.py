"""A third of all line items on one supplier and another third on one order: same results, whole results."""

import pytest

from conftest import SMALL
from __spark_entry__ import oracle_sql, queries
from oracle_check import TABLES, compare, connect
from klimawerk.session import shared_folder


@pytest.fixture(scope="module")
def skewed(spark):
    import os
    import tempfile

    folder = tempfile.mkdtemp(prefix="skewed-", dir=shared_folder(spark))
    con = connect(SMALL)
    for t in TABLES:
        if t != "lineitem":
            os.symlink(f"{SMALL}/{t}.parquet", f"{folder}/{t}.parquet")
    con.execute(f"""
        COPY (SELECT * REPLACE (
            CASE WHEN n % 3 = 0 THEN 0 ELSE l_suppkey END AS l_suppkey,
            CASE WHEN n % 3 = 1 THEN 7 ELSE l_orderkey END AS l_orderkey)
          FROM (SELECT *, row_number() OVER () AS n FROM lineitem))
        TO '{folder}/lineitem.parquet' (FORMAT parquet)""")
    return folder


@pytest.mark.parametrize("name", ["cln_gapfill", "agg_yearly", "tbl_averaged_year", "dev_temp_year", "win_warm_cold", "src_station_counts"])
def test_skewed_input(spark, skewed, name):
    problems = compare(queries()[name](spark, skewed), connect(skewed), oracle_sql()[name])
    assert [p for p in problems if p != "no rows"] == []
