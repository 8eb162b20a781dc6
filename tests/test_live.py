import json

import pytest

from klimawerk.session import fresh_folder
from klimawerk.streaming import live


def payload(dt, temp=293.15, deg=200, rain="absent", text="Regen"):
    observation = {
        "dt": dt, "main": {"temp": temp, "pressure": 1013, "humidity": 60}, "wind": {"speed": 5.0, "deg": deg},
        "weather": [{"description": text}],
    }
    if rain != "absent":
        observation["rain"] = rain
    return json.dumps({"list": [observation]})


@pytest.fixture
def landed(spark):
    rows = [
        ("0001", payload(1717243200)),
        ("0001", payload(1717243300, rain=None, deg=0)),
        ("0002", payload(1704067200, rain={"1h": 1.5}, temp=253.15)),
        ("0002", "not json"),
        ("0003", '{"list": []}'),
    ]
    return spark.createDataFrame(rows, live.LANDED)


def test_normalise(landed):
    row = live.normalise(landed).filter("dt = 1717243200").first()
    assert (row.station_id, row.local_time, row.description) == ("0001", "01. Jun. 2024 14:00", "Regen")
    assert (round(row.temp, 9), row.pressure, row.humidity, row.wind_kmh, row.wind_deg, row.rain) == (20.0, 1013, 60, 18.0, 200, 0.0)
    assert live.normalise(landed).filter("dt = 1704067200").first().rain == 1.5
    assert live.normalise(landed).filter("dt is null").count() == 2


def test_latest_wind_rose_and_bands(landed):
    observations = live.normalise(landed).filter("dt is not null")
    assert {r.station_id: r.dt for r in live.latest(observations).collect()} == {"0001": 1717243300, "0002": 1704067200}
    rose = {(r.station_id, r.sector): r.n_observations for r in live.wind_rose(observations).collect()}
    assert rose == {("0001", "SSW"): 1, ("0001", "N"): 1, ("0002", "SSW"): 1}
    bands = {r.dt: (r.temp_band, r.pressure_band, r.humidity_band) for r in live.with_bands(observations).collect()}
    assert bands == {1717243200: (3, 2, 2), 1717243300: (3, 2, 2), 1704067200: (1, 2, 2)}


def test_stream_equals_batch_over_several_batches(spark, landed):
    folder = fresh_folder(spark, "test-landed")
    valid = landed.filter("payload like '{\"list\": [{%'")
    for _ in range(3):
        valid.coalesce(1).write.mode("append").json(folder)
    later = spark.createDataFrame([("0002", payload(1717250000))], live.LANDED)
    later.coalesce(1).write.mode("append").json(folder)
    stream = live.read_landed_stream(spark, folder, files_per_batch=1)

    table = fresh_folder(spark, "test-normalised")
    live.write_normalised(stream, table, fresh_folder(spark, "test-checkpoint")).awaitTermination()
    batch = live.normalise(spark.read.schema(live.LANDED).json(folder))
    assert sorted(map(str, spark.read.parquet(table).collect())) == sorted(map(str, batch.collect()))

    latest = fresh_folder(spark, "test-latest")
    query = live.write_latest(stream, latest, fresh_folder(spark, "test-checkpoint"))
    query.awaitTermination()
    assert sorted(map(str, live.read_latest(spark, latest).collect())) == sorted(map(str, live.latest(batch).collect()))
    assert spark.read.parquet(f"{latest}/changes").select("batch_id").distinct().count() == 4
    last = spark.read.parquet(f"{latest}/changes").filter("batch_id = 3")
    assert [r.station_id for r in last.collect()] == ["0002"]  # a batch writes only what it changes


def test_old_versions_are_emptied(spark):
    folder, table = fresh_folder(spark, "test-landed"), fresh_folder(spark, "test-latest")
    assert live.read_latest(spark, table).count() == 0
    rows = [(f"{i % 3:04d}", 1717243200 + i) for i in range(7)]
    for station, dt in rows:
        spark.createDataFrame([(station, payload(dt))], live.LANDED).coalesce(1).write.mode("append").json(folder)
    stream = live.read_landed_stream(spark, folder, files_per_batch=1)
    live.write_latest(stream, table, fresh_folder(spark, "test-checkpoint"), compact_every=2).awaitTermination()
    assert {r.station_id: r.dt for r in live.read_latest(spark, table).collect()} == dict(rows)
    left = {part: {r.batch_id for r in spark.read.parquet(f"{table}/{part}").select("batch_id").collect()} for part in ("base", "changes")}
    assert left == {"base": {3, 5}, "changes": {6}}


def test_latest_is_a_hash_aggregate_and_settles_ties(spark):
    rows = [("0001", payload(10, text="a")), ("0001", payload(10, text="b")), ("0002", "bad"), (None, payload(5))]
    found = live.latest(live.normalise(spark.createDataFrame(rows, live.LANDED)))
    assert {(r.station_id, r.dt, r.description) for r in found.collect()} == {("0001", 10, "b"), ("0002", None, None), (None, 5, "Regen")}
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_restart_does_not_repeat_observations(spark, landed):
    folder, table, checkpoint = (fresh_folder(spark, n) for n in ("test-landed", "test-table", "test-checkpoint"))
    landed.coalesce(1).write.json(folder)
    for _ in range(2):
        live.write_normalised(live.read_landed_stream(spark, folder), table, checkpoint).awaitTermination()
    assert spark.read.parquet(table).count() == landed.count()


def test_redelivered_payloads_are_appended_once(spark, landed):
    folder, table, checkpoint = (fresh_folder(spark, n) for n in ("test-landed", "test-table", "test-checkpoint"))
    valid = landed.filter("payload like '%dt%'")
    for _ in range(2):
        valid.coalesce(1).write.mode("append").json(folder)
    live.write_normalised(live.read_landed_stream(spark, folder, 1), table, checkpoint, "365 days").awaitTermination()
    # Delivered again to a later run, beside a new observation and a payload without time.
    later = spark.createDataFrame([("0002", payload(1717250000)), ("0002", "not json")], live.LANDED)
    valid.unionByName(later).coalesce(1).write.mode("append").json(folder)
    live.write_normalised(live.read_landed_stream(spark, folder, 1), table, checkpoint, "365 days").awaitTermination()
    expected = live.normalise(valid.unionByName(later)).collect()
    assert sorted(map(str, spark.read.parquet(table).collect())) == sorted(map(str, expected))
