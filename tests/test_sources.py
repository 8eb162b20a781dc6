import json

from pyspark.sql import functions as F
import pytest

from conftest import FIXTURES
from klimawerk.operators import geo, stations
from klimawerk.operators.cleaning import add_date_parts, clean
from klimawerk.session import fresh_folder
from klimawerk.sources import geojson, materialised, station_files


@pytest.fixture(scope="module")
def files(spark):
    return station_files.read_station_files(spark, str(FIXTURES / "dwd" / "*.txt"))


def test_padded_station_files(files):
    assert {r.station_id: r.n_rows for r in station_files.station_counts(files).collect()} == {"0403": 3, "10015": 2}
    row = files.filter("station_id = '0403' and MESS_DATUM = 20200101").first()
    assert (row.STATIONS_ID, row.SDK, row.TNK, row.PM, row.QN_3) == (403, -999.0, -3.1, 1026.3, 10)
    assert [str(r.Date) for r in add_date_parts(files).filter("station_id = '0403'").orderBy("MESS_DATUM").collect()] == ["2020-01-01", "None", "2020-03-01"]


def test_file_with_other_column_order_fails(spark):
    with pytest.raises(Exception, match="header|CSV"):
        station_files.read_station_files(spark, str(FIXTURES / "other" / "*.txt")).collect()


@pytest.mark.parametrize("path, expected", [
    ("/a/produkt_klima_tag_19500101_20231231_00403.txt", "0403"),
    ("/a/produkt_klima_tag_19500101_20231231_10015.txt", "10015"),
    ("/a/file=produkt_klima_tag_00077.txt/part-00001-12345.csv", "0077"),
    ("/a/produkt_klima_tag_19500101_20231231_00123456.txt", "123456"),
    ("/a/produkt_klima_tag_19500101_20231231_9999999999.txt", "9999999999"),
    ("/a/123.txt", None),
    ("/a/readme.md", None),
])
def test_station_id_of(spark, path, expected):
    assert spark.createDataFrame([(path,)], "p string").select(station_files.station_id_of(F.col("p"))).first()[0] == expected


def test_station_files_round_trip(spark, raw_days):
    frame = raw_days([("0007", "2001-01-01", {"TMK": 1.5, "SDK": -999}), ("0123", "2001-01-01", {"TMK": -2.25})])
    folder = fresh_folder(spark, "test-station-files")
    station_files.write_station_files(frame, folder)
    back = station_files.read_station_files(spark, f"{folder}/*")
    got = {r.station_id: (r.MESS_DATUM, r.TMK, r.SDK, r.STATIONS_ID) for r in back.collect()}
    assert got == {"0007": (20010101, 1.5, -999.0, 7), "0123": (20010101, -2.25, None, 123)}


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_export_round_trip(spark, fmt):
    table = spark.createDataFrame([("0001", 2001, 1.25, None), ("0002", 2002, None, 3)], "`Station Nr` string, Jahr int, `Trübe Tage` double, n bigint")
    path = fresh_folder(spark, "test-export")
    station_files.export_table(table, path, fmt)
    back = station_files.read_export(spark, path, table.schema, fmt)
    assert sorted(map(str, back.collect())) == sorted(map(str, table.collect()))
    with pytest.raises(ValueError):
        station_files.export_table(table, path, "xlsx")


def test_union_by_name(spark):
    a = spark.createDataFrame([("0001", 1)], "station_id string, n int")
    b = spark.createDataFrame([(2, "0002", "x")], "n int, station_id string, extra string")
    got = {r.station_id: (r.n, r.extra) for r in station_files.union_stations([a, b]).collect()}
    assert got == {"0001": (1, None), "0002": (2, "x")}


def test_station_points(spark):
    points = geojson.station_points(geojson.read_feature_collections(spark, str(FIXTURES / "stations.geojson")))
    got = {r.number: (r.name, r.height, r.lon, r.lat) for r in points.collect()}
    assert got["0003"] == ("Südberg", 1200.0, 10.25, 47.5) and len(got) == 3
    assert stations.find_station(points, "Ostheide", "0002").count() == 1
    daily = spark.createDataFrame([("0001", 1.0), ("0001", 2.0), ("0009", 1.0)], "station_id string, TMK double")
    assert [r.number for r in stations.stations_with_data(points, daily).collect()] == ["0001"]
    assert stations.with_station(daily, points).count() == 2


def test_outlines(spark):
    rings = geojson.outline_rings(geojson.read_feature_collections(spark, str(FIXTURES / "outlines.geojson")))
    assert tuple(geo.bounding_box(rings).first()) == (0.0, 0.0, 2.0, 1.0)
    edges = [tuple(r) for r in geo.boundary_edges(rings).collect()]
    assert len(edges) == len(set(edges)) == 7
    assert (1.0, 0.0, 1.0, 1.0) in edges


def test_clean_table_on_disk(spark):
    from conftest import SMALL
    from klimawerk.workload import inputs

    clean = inputs.cleaned(spark, SMALL)
    path = fresh_folder(spark, "test-clean")
    materialised.write_clean(clean, path)
    back = materialised.read_clean(spark, path)
    assert back.count() == clean.count() and set(back.columns) == set(clean.columns)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        materialised.write_clean(clean, path)
    materialised.write_clean(clean, path, replace=True)
    assert materialised.read_clean(spark, path).count() == clean.count()
    plan = back.filter("Jahr = 2000").select("TMK")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Jahr" in plan


def test_overlapping_files_of_a_station(spark, raw_days):
    """Days that two files repeat are kept once on request; without it, or with other values, cleaning fails."""
    year = [f"2001-{m:02}-{d:02}" for m in range(1, 13) for d in range(1, 29)]
    first = raw_days([("0403", day, {"TMK": 1.0}) for day in year])
    second = raw_days([("0403", day, {"TMK": 1.0}) for day in year[100:]])
    other = raw_days([("0403", year[0], {"TMK": 2.0})])

    def read(*frames, overlapping):
        top = fresh_folder(spark, "test-overlap")
        for n, frame in enumerate(frames):
            station_files.write_station_files(frame, f"{top}/{n}")
        return station_files.read_station_files(spark, f"{top}/*/*", overlapping)

    assert clean(read(first, second, overlapping=True)).count() == len(year)
    for frames, overlapping in (((first, second), False), ((first, other), True)):
        with pytest.raises(Exception, match="two rows of station 0403 on 2001-"):
            clean(read(*frames, overlapping=overlapping)).collect()


def test_documents_are_parsed_once(spark):
    from conftest import SMALL
    from klimawerk.workload import inputs

    collections = geojson.parse_feature_collections(inputs.outline_documents(spark, SMALL))
    plan = geojson.outline_rings(collections)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(StructField(features") == 1


def test_loaded_counts(spark):
    raw = spark.createDataFrame([("0001",), ("0001",), ("0002",)], "station_id string")
    kept = raw.filter("station_id = '0001'")
    counts = {r.station_id: (r.n_rows, r.n_file_rows) for r in station_files.loaded_counts(raw, kept).collect()}
    assert counts == {"0001": (2, 2), "0002": (0, 1)}
    assert tuple(station_files.loaded_total(kept).first()) == (1, 2)
    assert tuple(station_files.loaded_total(kept.limit(0)).first()) == (0, 0)


def test_one_large_document_is_read_by_several_tasks(spark, tmp_path):
    """Braces, quotes and backslashes in names, objects that are no features, and any layout, cut anywhere."""
    names = ["plain", 'a "quoted" } name', "brace { only", "back\\", 'back\\"', "{}{}}}", "größer 日本", "", '\\\\"}', "line\nbreak"]
    features = [
        {
            "type": "Feature", "properties": {"name": names[i % len(names)] + str(i), "number": f"{i:04d}", "height": i / 2, "more": {"a": {"b": i}}},
            "geometry": {"type": "Point", "coordinates": [i / 10, -i / 10]},
        }
        for i in range(3000)
    ]
    document = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x"}}, "features": features, "tail": {"type": "x"}}
    paths = [str(tmp_path / f"{i}.geojson") for i in range(3)]
    for path, indent in zip(paths, (None, 2, 7)):
        with open(path, "w", encoding="utf-8") as out:
            json.dump(document, out, indent=indent, ensure_ascii=indent is None)
    expected = sorted((f["properties"]["name"], f["properties"]["number"], f["properties"]["height"], *f["geometry"]["coordinates"]) for f in features)
    set_ = {"spark.sql.files.maxPartitionBytes": "10001", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in set_}
    try:
        for k, v in set_.items():
            spark.conf.set(k, v)
        for path in paths:
            read = geojson.read_large_collections(spark, path)
            assert sorted(map(tuple, geojson.station_points(read).collect())) == expected
            assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 8
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    small = geojson.station_points(geojson.read_large_collections(spark, str(FIXTURES / "stations.geojson")))
    plain = geojson.station_points(geojson.read_feature_collections(spark, str(FIXTURES / "stations.geojson")))
    assert sorted(map(str, small.collect())) == sorted(map(str, plain.collect()))
