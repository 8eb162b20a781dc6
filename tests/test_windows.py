from datetime import date

import pytest

from klimawerk.operators import running, spells


@pytest.fixture
def rain(spark):
    def make(rows, station="0001"):
        data = [(station, date.fromisoformat(d), int(d[:4]), flag) for d, flag in rows]
        return spark.createDataFrame(data, "station_id string, Date date, Jahr int, Regentag int")

    return make


def longest(df):
    return {r.Jahr: (r.Maximale_Trockenperiode, r.Maximale_Regenperiode) for r in spells.longest_spells(df).collect()}


def test_longest_runs(rain):
    flags = [0, 0, 1, 1, 1, 0, 1]
    assert longest(rain([(f"2001-01-0{i + 1}", f) for i, f in enumerate(flags)])) == {2001: (2, 3)}


def test_runs_follow_rows_over_missing_days(rain):
    assert longest(rain([("2001-01-01", 0), ("2001-01-02", 0), ("2001-01-05", 0)])) == {2001: (3, None)}


def test_runs_end_at_new_year(rain):
    rows = [("2001-12-30", 0), ("2001-12-31", 0), ("2002-01-01", 0), ("2002-01-02", 0)]
    assert longest(rain(rows)) == {2001: (2, None), 2002: (2, None)}


def test_warm_and_cold_segments(spark):
    rows = [(1, 5.0, 4.0), (2, 6.0, 4.0), (3, 4.0, 4.0), (4, 5.0, 4.0), (5, 1.0, 4.0), (6, 1.0, None), (7, 1.0, 4.0)]
    data = [("0001", 2001, date(2001, 1, d), t, n) for d, t, n in rows]
    df = spark.createDataFrame(data, "station_id string, Jahr int, Date date, TMK double, Average_TMK double")
    got = [(r.Abweichung, r.first_day.day, r.last_day.day, r.n_days) for r in spells.warm_cold_segments(df).orderBy("first_day").collect()]
    assert got == [("Zu warm", 1, 2, 2), ("Zu warm", 4, 4, 1), ("Zu kalt", 5, 5, 1), ("Zu kalt", 7, 7, 1)]


@pytest.mark.parametrize("policy, expected", [("propagate", [1.0, None, None]), ("skip", [1.0, 1.0, 3.0])])
def test_running_total_and_null(spark, policy, expected):
    data = [("0001", 1, 1.0), ("0001", 2, None), ("0001", 3, 2.0), ("0002", 1, 7.0)]
    df = spark.createDataFrame(data, "station_id string, Day int, RSK double")
    out = running.running_total(df, {"RSK": "total"}, ["station_id"], "Day", policy)
    assert [r.total for r in out.filter("station_id = '0001'").orderBy("Day").collect()] == expected
    assert [r.total for r in out.filter("station_id = '0002'").collect()] == [7.0]


def test_yearly_courses_leave_out_empty_years(spark):
    data = [("0001", 2001, 5.0, 1.0), ("0001", 2002, 0.0, 0.0), ("0001", 2003, 2.0, 3.0)]
    df = spark.createDataFrame(data, "station_id string, Jahr int, RSK double, SDK double")
    assert [(r.Jahr, r.Cumulative_RSK) for r in running.yearly_precipitation_course(df).orderBy("Jahr").collect()] == [(2001, 5.0), (2003, 7.0)]
    assert [(r.Jahr, r.Cumulative_SDK) for r in running.yearly_sunshine_course(df).orderBy("Jahr").collect()] == [(2001, 1.0), (2003, 4.0)]
