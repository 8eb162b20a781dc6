"""Rejected rows, and the store that keeps versions."""

import pytest
from pyspark.sql import functions as F

from klimawerk.operators.cleaning import clean
from klimawerk.plans.engine import ClimateEngine
from klimawerk.schema import MEASURES, STATION_FILE
from klimawerk.session import fresh_folder
from klimawerk.sources import station_files, versions

HEADER = ";".join(STATION_FILE.names)


def line(station, day, **values):
    texts = {"STATIONS_ID": station, "MESS_DATUM": day, "eor": "eor", **values}
    return ";".join(f"{texts.get(name, '-999'):>5}" for name in STATION_FILE.names)


@pytest.fixture
def folder(spark):
    """Two station files: one sound, one with a fault of each kind among ten rows."""
    path = fresh_folder(spark, "test-faults")
    good = [line("00011", f"200101{d:02d}", TMK="1.5", RSK="0.2") for d in range(1, 11)]
    bad = [line("00012", f"200101{d:02d}", TMK="2.5") for d in range(1, 8)]
    bad += [";".join(good[0].split(";")[:4]), line("00012", "20010109", TMK="1,5"), line("00012", "20010230", TMK="3.5")]
    for name, rows in (("tag_00011.txt", good), ("tag_00012.txt", bad)):
        spark.createDataFrame([(HEADER + "\n" + "\n".join(rows),)], "t string").coalesce(1).write.text(f"{path}/{name}")
    return path


def test_faulty_rows_are_kept_apart(spark, folder):
    landed = station_files.land_station_files(spark, f"{folder}/*", fresh_folder(spark, "test-landed"), max_share=0.3)
    assert {(r.station_id, r.n_rows, r.n_rejected) for r in landed.files.collect()} == {("0011", 10, 0), ("0012", 10, 3)}
    rejected = {(r.reason, r.rejected_line.replace(" ", "")[:14]) for r in landed.rejected.collect()}
    assert {r for r, _ in rejected} == {"malformed", "impossible_day"} and len(rejected) == 3
    assert any("1,5" in r.rejected_line for r in landed.rejected.where("reason = 'malformed'").collect())
    assert landed.days.groupBy("station_id").count().where("count = 7 or count = 10").count() == 2
    assert landed.days.where("TMK is null").count() == 0
    plain = station_files.read_station_files(spark, f"{folder}/tag_00011.txt")
    assert landed.days.where("station_id = '0011'").select(plain.columns).exceptAll(plain).count() == 0


def test_loading_fails_above_the_share_and_keeps_the_rows(spark, folder):
    target = fresh_folder(spark, "test-landed")
    with pytest.raises(station_files.TooManyRejected, match="3 of 10 rows of .*tag_00012.txt"):
        station_files.land_station_files(spark, f"{folder}/*", target, max_share=0.2)
    assert spark.read.parquet(target).where("reason != 'ok'").count() == 3


def year_of(raw_days, station, year, value):
    return raw_days([(station, f"{year}-{m:02d}-{d:02d}", {"TMK": value, "RSK": 1.0}) for m in range(1, 13) for d in (1, 15)])


@pytest.fixture
def store(spark, raw_days):
    found = versions.StationStore(spark, fresh_folder(spark, "test-store"))
    assert found.put(year_of(raw_days, "0001", 2001, 1.0).union(year_of(raw_days, "0002", 2001, 2.0))) == 1
    return found


def means(days):
    return {(r.station_id, r.Jahr): r.m for r in days.groupBy("station_id", "Jahr").agg(F.avg("TMK").alias("m")).collect()}


def test_only_the_given_station_is_written(spark, store, raw_days):
    old = store.read()
    assert store.put(year_of(raw_days, "0003", 2002, 3.0)) == 2
    assert means(store.read()) == {("0001", 2001): 1.0, ("0002", 2001): 2.0, ("0003", 2002): 3.0}
    part = store._parts(2)[-1]["name"]
    assert means(spark.read.parquet(f"{store.path}/parts/{part}/days")) == {("0003", 2002): 3.0}
    store.put(year_of(raw_days, "0002", 2001, 5.0).union(year_of(raw_days, "0002", 2002, 6.0)))
    assert means(old) == {("0001", 2001): 1.0, ("0002", 2001): 2.0}
    assert means(store.read(2))["0002", 2001] == 2.0
    assert means(store.read()) == {("0001", 2001): 1.0, ("0002", 2001): 5.0, ("0002", 2002): 6.0, ("0003", 2002): 3.0}
    assert ClimateEngine.from_store(spark, store.path, version=1).days.count() == 48


def test_rows_are_those_of_cleaning_everything(store, raw_days):
    more = year_of(raw_days, "0002", 2001, -999.0).union(year_of(raw_days, "0002", 2002, 4.0)).union(year_of(raw_days, "0002", 2003, 8.0))
    store.put(more)
    expected = clean(year_of(raw_days, "0001", 2001, 1.0).union(more))
    columns = ["station_id", "Date", *MEASURES]
    assert sorted(map(str, store.read().select(columns).collect())) == sorted(map(str, expected.select(columns).collect()))


def test_a_station_without_a_complete_year_loses_its_rows(store, raw_days):
    store.put(raw_days([("0002", "2001-01-01", {"TMK": 1.0})]))
    assert set(means(store.read())) == {("0001", 2001)}


def test_failed_and_rival_changes_leave_the_current_version(store, raw_days, monkeypatch):
    two_rows = year_of(raw_days, "0002", 2001, 9.0)
    with pytest.raises(Exception, match="two rows"):
        store.put(two_rows.union(two_rows))
    assert store.versions() == [1] and means(store.read())["0002", 2001] == 2.0
    commit = store._commit

    def rival(version, parts):
        commit(version, store._parts(1))
        commit(version, parts)

    monkeypatch.setattr(store, "_commit", rival)
    with pytest.raises(RuntimeError, match="another change"):
        store.put(year_of(raw_days, "0001", 2001, 7.0))
    assert store.versions() == [1, 2] and means(store.read())["0001", 2001] == 1.0


def test_parts_are_joined_and_old_versions_expire(spark, store, raw_days, monkeypatch):
    monkeypatch.setattr(versions, "MAX_PARTS", 2)
    store.put(year_of(raw_days, "0003", 2002, 3.0))
    store.put(year_of(raw_days, "0001", 2001, 4.0))
    assert len(store._parts(3)) == 1 and len(store._parts(2)) == 2
    expected = {("0001", 2001): 4.0, ("0002", 2001): 2.0, ("0003", 2002): 3.0}
    assert means(store.read()) == expected
    store.expire(keep=1)
    assert store.versions() == [3] and means(store.read()) == expected
    with pytest.raises(ValueError, match="no version 1"):
        store.read(1)
    assert store.compact() == 4 and means(store.read()) == expected


def test_an_empty_store_can_not_be_read(spark):
    with pytest.raises(ValueError, match="no version"):
        versions.StationStore(spark, fresh_folder(spark, "test-store")).read()
