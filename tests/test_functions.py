import math
from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from klimawerk.functions import dates, measures, scales, solar
from klimawerk.operators import sunshine


def column(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def test_compass(spark):
    degrees = [0.0, 11.25, 33.75, 90.0, 348.75, 360.0, 200.0, 400.0]
    got = [r[0] for r in column(spark, degrees).select(scales.compass_sector(F.col("v"))).collect()]
    assert got == ["N", "N", "NE", "E", "N", "N", "SSW", None]


def test_bands(spark):
    got = [r[0] for r in column(spark, [-20.0, -0.1, 0.0, 19.9, 20.0, 40.0, 41.0, None]).select(scales.band(F.col("v"), -20, 40)).collect()]
    assert got == [1, 1, 2, 2, 3, 3, None, None]


def test_precipitation_scale_and_classes(spark):
    df = column(spark, [0.0, 0.05, 0.1, 7.5, 50.0, 80.0, None])
    assert [r[0] for r in df.select(scales.precip_class(F.col("v"))).collect()] == [0.0, 0.0, 0.1, 5.0, 50.0, 50.0, None]
    back = df.select("v", scales.precip_unscale(scales.precip_scale(F.col("v"))).alias("b")).filter("v is not null").collect()
    assert all(math.isclose(r.v, r.b, abs_tol=1e-12) for r in back)


@pytest.mark.parametrize("lat, doy, hours", [
    (52.4537, 1, 7.52), (52.4537, 81, 12.0), (52.4537, 172, 16.59), (52.4537, 355, 7.41), (70.0, 1, 0.0), (70.0, 172, 24.0),
])
def test_day_length(spark, lat, doy, hours):
    day = date.fromordinal(date(2001, 1, 1).toordinal() + doy - 1)
    df = spark.createDataFrame([(lat, day)], "lat double, d date")
    assert round(df.select(solar.day_length(F.col("lat"), F.col("d"))).first()[0], 2) == hours


def test_day_length_series(spark):
    stations = spark.createDataFrame([("0001", 52.4537), ("0002", -80.0)], "station_id string, lat double")
    year = sunshine.day_lengths(stations, 2000)
    assert year.count() == 2 * 366
    assert year.filter("sunshine_duration < 0 or sunshine_duration > 24").count() == 0
    july = sunshine.day_lengths(stations, 2001, 7)
    assert (july.count(), july.first().Monat_german) == (62, "Juli")


def test_overlay_keeps_days_without_measurement(spark):
    stations = spark.createDataFrame([("A", "0001", 1.0, 8.0, 50.0)], "name string, number string, height double, lon double, lat double")
    days = spark.createDataFrame(
        [("0001", date(2001, 1, 1), 3.0), ("0001", date(2001, 1, 2), None), ("0009", date(2001, 1, 1), 1.0), ("0005", date(2001, 1, 1), None)],
        "station_id string, Date date, SDK double",
    )
    out = sunshine.sunshine_overlay(days, stations, 2001).cache()
    assert out.count() == 2 * 365  # 0005 has no measurement
    assert out.filter("SDK is not null").count() == 2
    assert out.filter("station_id = '0009' and sunshine_duration is not null").count() == 0  # it has no position
    assert out.filter("station_id = '0001' and sunshine_duration is null").count() == 0
    default = sunshine.sunshine_overlay(days, None, 2001)
    assert default.filter("sunshine_duration is not null").count() == 2 * 365


def test_dates(spark):
    df = column(spark, [20200229, 20200230, 20011301, None], "int")
    assert [r[0] for r in df.select(dates.parse_day(F.col("v"))).collect()] == [date(2020, 2, 29), None, None, None]
    assert [r[0] for r in column(spark, [1, 3, 12, None], "int").select(dates.month_label(F.col("v"))).collect()] == ["Januar", "März", "Dezember", None]
    assert dates.period_bounds("1991-2020") == (1991, 2020)
    assert dates.month_number("März") == 3


def test_local_time_follows_summer_time(spark):
    df = column(spark, [1717243200, 1704067200], "bigint")
    assert [r[0] for r in df.select(dates.local_time_text(F.col("v"))).collect()] == ["01. Jun. 2024 14:00", "01. Jan. 2024 01:00"]


@pytest.mark.parametrize("epoch, text", [
    (1709467200, "03. Mär. 2024 13:00"), (1714996800, "06. Mai. 2024 14:00"), (1728043200, "04. Okt. 2024 14:00"),
    (1733313600, "04. Dez. 2024 13:00"),
])
def test_local_time_has_german_months(spark, epoch, text):
    assert column(spark, [epoch], "bigint").select(dates.local_time_text(F.col("v"))).first()[0] == text


def test_local_time_does_not_depend_on_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = column(spark, [1717243200], "bigint")
        assert df.select(dates.local_time_text(F.col("v"))).first()[0] == "01. Jun. 2024 14:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_nearest_on_ties_and_signs(spark):
    values = [0.15, 0.25, 0.35, 0.45, 2.5, -0.04, -0.05, 3.0, None]
    got = [r[0] for r in column(spark, values).select(measures.nearest("v")).collect()]
    assert got == [0.1, 0.2, 0.3, 0.4, 2.5, 0.0, 0.0, 3.0, None]


def test_nearest_leaves_large_values_alone(spark):
    got = [r[0] for r in column(spark, [1e13, -1e13, 1e300, 9.3e12 + 0.5]).select(measures.nearest("v", 6)).collect()]
    assert got == [1e13, -1e13, 1e300, 9.3e12 + 0.5]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1e4, 1e4), min_size=20, max_size=60))
def test_nearest_is_within_half_a_step(spark, values):
    for r in column(spark, values).select("v", measures.nearest("v").alias("n")).collect():
        assert abs(r.v - r.n) <= 0.05 + 1e-9


def test_sum_of_nothing_is_zero_and_mean_of_nothing_is_null(spark):
    row = column(spark, [None, None]).agg(measures.total("v").alias("t"), measures.mean("v").alias("m")).first()
    assert (row.t, row.m) == (0.0, None)
