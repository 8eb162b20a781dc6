import pytest
from pyspark.sql import functions as F

from conftest import FIXTURES, SMALL
from klimawerk import ClimateEngine
from klimawerk.session import fresh_folder
from klimawerk.sources.geojson import read_feature_collections, station_points
from klimawerk.workload import inputs

PERIOD = (1995, 1998)


@pytest.fixture(scope="module")
def engine(spark):
    stations = station_points(read_feature_collections(spark, str(FIXTURES / "stations.geojson")))
    return ClimateEngine(inputs.cleaned(spark, SMALL), stations)


def test_every_view_in_every_mode(engine):
    for mode, args in [("einMonat", dict(year=2000, month=7)), ("alleMonate", dict(year=2000)), ("all", dict(month=7)), ("all", {})]:
        for view in (engine.temperature_series, engine.precipitation_series):
            extra = {} if mode == "all" else {"period": PERIOD}
            assert view(mode, **args, **extra).count() > 0
        for view in (engine.temperature_strip, engine.precipitation_strip, engine.sunshine_series, engine.cloud_strip):
            assert view(mode, **args).count() > 0
        for tiles in (engine.temperature_tiles, engine.precipitation_tiles, engine.sunshine_tiles):
            assert tiles(mode, **args, period=PERIOD).count() == 2
    assert engine.possible_sunshine("einMonat", 2000, 7).count() == 62
    assert engine.possible_sunshine("alleMonate", 2000).count() == 732


def test_sunshine_without_a_position(engine):
    with pytest.raises(ValueError, match="per day"):
        engine.possible_sunshine("all", 2000)
    with pytest.raises(ValueError, match="per day"):
        engine.possible_sunshine("all", 2000, 7)
    nowhere = ClimateEngine(engine.days).possible_sunshine("einMonat", 2000, 7)
    assert nowhere.filter("sunshine_duration is not null").count() == 62


def test_search_and_top_k(engine, spark):
    hot = engine.search({"column": "Tageshöchsttemperatur", "condition": ">", "value": [20.0]})
    assert hot.count() == engine.table().filter("`Tageshöchsttemperatur` > 20").count() > 0
    assert engine.text_search("2000-07").count() == engine.slice("einMonat", 2000, 7).count()
    best = engine.top_k("Niederschlag", 3, "averaged")
    assert best.count() == 6 and best.filter("Rang = 1").count() == 2
    landed = spark.createDataFrame([("0001", '{"list": [{"dt": 5}]}'), ("0001", '{"list": [{"dt": 7}]}')], "station_id string, payload string")
    assert [r.dt for r in ClimateEngine.latest(landed).collect()] == [7]


def test_modes_are_checked(engine):
    for bad in [("jahr", 2000, 1), ("alleMonate", None, None), ("einMonat", 2000, None)]:
        with pytest.raises(ValueError):
            engine.slice(*bad)


def test_choices_and_tables(engine):
    assert engine.periods() == ["1991-2020", "1981-2010", "1971-2000", "1961-1990"]
    assert engine.bounds().count() == 2 and engine.months().count() == 24
    assert engine.table().count() == engine.days.count()
    assert engine.table("averaged", 7).count() == engine.table("averaged").count()


def test_one_station(engine):
    one = engine.for_station("0002")
    assert [r.station_id for r in one.table("averaged").select("station_id").distinct().collect()] == ["0002"]


def test_from_station_files(spark):
    folder = fresh_folder(spark, "test-engine")
    from klimawerk.sources.station_files import write_station_files

    write_station_files(inputs.daily(spark, SMALL), folder)
    store = fresh_folder(spark, "test-store")
    engine = ClimateEngine.from_station_files(spark, f"{folder}/*", str(FIXTURES / "stations.geojson"), store)
    expected = inputs.cleaned(spark, SMALL)
    assert engine.days.count() == expected.count()
    total = lambda df: df.agg(F.round(F.sum("TMK"), 6), F.round(F.sum("SDK"), 6), F.sum("Regentag")).first()
    assert total(engine.days) == total(expected)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        ClimateEngine.from_station_files(spark, f"{folder}/*", store=store)
    again = ClimateEngine.open(spark, store, str(FIXTURES / "stations.geojson"))
    assert total(again.days) == total(expected) and again.stations.count() == 3
    plan = again.days._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan  # read, not cleaned
