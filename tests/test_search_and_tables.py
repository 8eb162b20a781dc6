from datetime import date

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from oracle_check import connect
from klimawerk.operators import layers, search, slices
from klimawerk.operators.reshape import temperatures_long
from klimawerk.operators.tables import averaged_table, daily_table
from klimawerk.workload.catalog import QUERIES
from klimawerk.workload.oracle import ORACLE


@pytest.fixture(scope="module")
def table(spark):
    rows = [
        ("0001", date(2001, 7, 1), 30.5, None, "Sonnig"),
        ("0001", date(2001, 8, 1), 12.5, 1.0, "Regen"),
        ("0001", date(2001, 9, 1), 12.5, 2.0, "regenreich"),
        ("0002", date(2001, 7, 15), -3.0, 4.5, None),
    ]
    return spark.createDataFrame(rows, "station_id string, Datum date, `T max` double, n double, text string")


@pytest.mark.parametrize("leaf, expected", [
    ({"column": "T max", "condition": "=", "value": [12.5]}, 2),
    ({"column": "T max", "condition": "!=", "value": [12.5]}, 2),
    ({"column": "T max", "condition": "<", "value": [12.5]}, 1),
    ({"column": "T max", "condition": "<=", "value": [12.5]}, 3),
    ({"column": "T max", "condition": ">", "value": [12.5]}, 1),
    ({"column": "T max", "condition": ">=", "value": [12.5]}, 3),
    ({"column": "T max", "condition": "between", "value": [0, 20]}, 2),
    ({"column": "T max", "condition": "!between", "value": [0, 20]}, 2),
    ({"column": "n", "condition": "!=", "value": [1.0]}, 3),
    ({"column": "n", "condition": "!between", "value": [0, 1]}, 3),
    ({"column": "n", "condition": "null"}, 1),
    ({"column": "n", "condition": "!null"}, 3),
    ({"column": "text", "condition": "starts", "value": ["REGEN"]}, 2),
    ({"column": "text", "condition": "!starts", "value": ["regen"]}, 2),
    ({"column": "text", "condition": "ends", "value": ["reich"]}, 1),
    ({"column": "text", "condition": "!ends", "value": ["reich"]}, 3),
    ({"column": "text", "condition": "contains", "value": ["nn"]}, 1),
    ({"column": "text", "condition": "!contains", "value": ["nn"]}, 3),
])
def test_conditions(table, leaf, expected):
    assert search.search_builder(table, {"logic": "AND", "criteria": [leaf]}).count() == expected


def test_nested_conditions(table):
    tree = {"logic": "OR", "criteria": [
        {"column": "station_id", "condition": "=", "value": ["0002"]},
        {"logic": "AND", "criteria": [
            {"column": "T max", "condition": "=", "value": [12.5]}, {"column": "n", "condition": ">", "value": [1.5]},
        ]},
    ]}
    assert search.search_builder(table, tree).count() == 2
    assert search.search_builder(table, {"logic": "AND", "criteria": []}).count() == 4


def test_text_search_needs_every_word(table):
    assert search.text_search(table, "REGEN").count() == 2
    assert search.text_search(table, "regen 2001-08").count() == 1
    assert search.text_search(table, "").count() == 4


def test_top_k(table):
    order = [F.desc_nulls_last("T max"), F.asc("Datum")]
    got = search.top_k(table, order, 2).orderBy("station_id", "Rang").collect()
    assert [(r.station_id, r.Rang, str(r.Datum)) for r in got] == [("0001", 1, "2001-07-01"), ("0001", 2, "2001-08-01"), ("0002", 1, "2001-07-15")]
    assert [str(r.Datum) for r in search.top_k(table, order, 1, keys=[]).collect()] == ["2001-07-01"]


def test_sort_puts_missing_last(table):
    assert [r.n for r in slices.sorted_output(table, "n").collect()] == [1.0, 2.0, 4.5, None]


def test_layer_values(spark):
    readings = spark.createDataFrame(
        [("dwd:TAMM_17_1961_30", 85.0), ("dwd:RSMS_17_1961_30", 85.0)], "layer string, raw double"
    )
    assert sorted(r.label for r in layers.layer_values(readings).collect()) == [
        "Durchschnittstemperatur (1961-1990): 8.5 °C", "Niederschlag pro Jahr (1961-1990): 85.0 mm",
    ]


def test_long_form(spark):
    df = spark.createDataFrame([("0001", 1.0, 2.0, None)], "station_id string, TNK double, TMK double, TXK double")
    got = [(r.Cat, r.value) for r in temperatures_long(df, ["station_id"]).orderBy("Cat_order").collect()]
    assert got == [("TNK", 1.0), ("TMK", 2.0), ("TXK", None)]


def test_table_layouts(spark):
    from conftest import SMALL
    from klimawerk.workload import inputs

    clean = inputs.cleaned(spark, SMALL)
    assert len(averaged_table(clean).columns) == 18 + 1
    assert len(averaged_table(clean, 7).columns) == 16 + 1
    assert averaged_table(clean, 7).first().Monat_Jahr.startswith("Juli ")
    assert daily_table(clean).columns[-1] == "Temperaturspanne"
    spells = averaged_table(clean).filter("Maximale_Trockenperiode + Maximale_Regenperiode > 366")
    assert spells.count() == 0


def test_sorted_output_is_read_back_in_order_over_several_files(spark, tmp_path):
    folder = str(tmp_path / "sorted")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        QUERIES["srt_yearly"](spark, SMALL).write.parquet(folder)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    files = sorted(str(f) for f in (tmp_path / "sorted").glob("part-*.parquet"))
    assert len(files) > 1
    found = [row for f in files for row in zip(*pq.read_table(f, columns=["Jahr", "station_id"]).to_pydict().values())]
    expected = connect(SMALL).sql(
        f"SELECT Jahr, station_id FROM ({ORACLE['srt_yearly']}) ORDER BY Jahr NULLS LAST, station_id NULLS LAST"
    ).fetchall()
    assert found == expected
