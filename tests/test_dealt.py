"""Inputs that need whole stations are made with one exchange by station, and give the rows of the stepwise way."""

import io
from contextlib import redirect_stdout
from pathlib import Path

from pyspark.sql import functions as F

from conftest import SMALL
from klimawerk.operators.cleaning import clean
from klimawerk.session import fresh_folder
from klimawerk.sources import materialised, station_files
from klimawerk.workload import inputs


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_cleaning_of_dealt_rows_needs_no_other_exchange(spark):
    dealt = clean(inputs.derive_daily(spark, SMALL), dealt=True)
    assert plan(dealt).count("Exchange hashpartitioning(station_id") == 1
    stepwise = clean(inputs.daily(spark, SMALL)).select(*dealt.columns)
    assert dealt.exceptAll(stepwise).isEmpty() and stepwise.exceptAll(dealt).isEmpty()


def test_clean_table_of_dealt_rows(spark):
    rows = clean(inputs.derive_daily(spark, SMALL), dealt=True)
    path = fresh_folder(spark, "test-dealt-clean")
    materialised.write_clean(rows, path, dealt=True)
    back = materialised.read_clean(spark, path).select(*rows.columns)
    assert back.exceptAll(rows).isEmpty() and rows.exceptAll(back).isEmpty()
    # A station is in one file of each year.
    files = back.select("station_id", "Jahr", F.col("_metadata.file_name").alias("file")).distinct()
    assert files.groupBy("station_id", "Jahr").count().where("count > 1").isEmpty()


def test_station_files_of_dealt_rows(spark):
    raw = inputs.derive_daily(spark, SMALL)
    folder = fresh_folder(spark, "test-dealt-files")
    station_files.write_station_files(raw, folder, dealt=True)
    assert all(p.name.endswith(".csv.gz") for p in Path(folder).glob("*/part-*"))
    back = station_files.read_station_files(spark, f"{folder}/*").select(*raw.columns)
    assert back.exceptAll(raw).isEmpty() and raw.exceptAll(back).isEmpty()
