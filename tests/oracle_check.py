"""Run registered queries beside their SQL in DuckDB and compare names, types' families, row counts and values.

Usage: python tests/oracle_check.py <table folder> [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences as text; empty when equal."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    got = spark_df.collect()
    problems = []
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(names)}"]
    if len(got) != len(expected):
        problems.append(f"rows {len(got)} != {len(expected)}")
    if not expected:
        problems.append("no rows")
    left, right = _rows(spark_df.columns, got), _rows(names, expected)
    if left != right:
        a, b = left - right, right - left
        problems.append(f"{sum(a.values())} rows differ, e.g. {sorted(a)[:2]} != {sorted(b)[:2]}")
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    family = {"string": "VARCHAR", "double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER", "date": "DATE", "boolean": "BOOLEAN"}
    types = {n: (k, kinds[n]) for n, k in spark_df.dtypes if family.get(k) != kinds[n]}
    if types:
        problems.append(f"types {types}")
    return problems


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from klimawerk.session import local_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), connect(sf_dir)
    failed = 0
    for name, fn in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            problems = compare(df, con, oracle_sql()[name]) if name in oracle_sql() else []
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:700]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.2f}s {' | '.join(problems)}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main()))
