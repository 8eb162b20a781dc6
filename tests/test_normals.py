from datetime import date, timedelta

import pytest

from klimawerk.operators import cleaning, deviation, normals, running, slices


def year_days(year):
    day = date(year, 1, 1)
    while day.year == year:
        yield day
        day += timedelta(days=1)


@pytest.fixture
def clean(raw_days):
    rows = []
    for year in range(2001, 2006):
        for day in year_days(year):
            new_year = day.month == 1 and day.day == 1
            values = {"RSK": 3 if new_year else 0, "TMK": year - 2000, "TXK": year - 1990, "TNK": -1, "SDK": 2, "NM": 7}
            rows.append(("0001", day, values))
    return cleaning.clean(raw_days(rows)).cache()


def test_daily_normal_uses_the_nominal_divisor(clean):
    first = normals.daily_normals(clean, (2001, 2004)).filter("Month = 1 and Day = 1").first()
    assert first.Average_RSK == 0.4
    assert first.Average_TMK == 2.5
    assert first.Average_SDK == 8.0
    assert normals.daily_normals(clean, (2001, 2004)).count() == 365
    assert normals.daily_normals(clean, (2001, 2004), divisor=4).filter("Month = 1 and Day = 1").first().Average_RSK == 3.0


def test_running_normal_stops_at_leap_day(clean):
    days = normals.join_year_normals(slices.select_days(clean, year=2004), normals.daily_normals(clean, (2001, 2003)))
    course = running.precipitation_course(days)
    assert course.count() == 366
    assert course.filter("Cumulative_avg_RSK is not null").agg({"Date": "max"}).first()[0] == date(2004, 2, 28)
    assert course.filter("Cumulative_RSK is null").count() == 0
    skipped = running.precipitation_course(days, null_policy="skip").filter("Date = date'2004-12-31'").first()
    assert skipped.Cumulative_avg_RSK == 0.3


def test_month_join_keeps_leap_day_without_normal(clean):
    days = slices.select_days(clean, year=2004, month=2)
    joined = normals.join_month_normals(days, normals.daily_normals(clean, (2001, 2003)), 2004, 2)
    assert joined.count() == 29
    assert [r.Date for r in joined.filter("Average_TMK is null").collect()] == [date(2004, 2, 29)]


def test_deviations_match_single_normals(clean):
    row = deviation.deviations(clean, 2005, (2001, 2004)).first()
    assert (row.TMK, row.TMK_normal, row.TMK_diff) == (5.0, 2.5, 2.5)
    assert (row.RSK, row.RSK_normal, row.RSK_diff) == (3.0, 3.0, 0.0)
    assert (row.Truebertag, row.Truebertag_normal, row.Truebertag_diff) == (365.0, 365.25, -0.2)
    single = normals.mean_over_time(clean, "Frosttag", (2001, 2004), is_day=True).first().Average_column
    assert row.Frosttag_normal == single == 365.25
    month = deviation.deviations(clean, 2004, (2001, 2003), month=2, metrics=["SDK"]).first()
    assert (month.SDK, month.SDK_normal, month.SDK_diff) == (58.0, 56.0, 2.0)


def test_selected_year_inside_the_period(clean):
    row = deviation.deviations(clean, 2002, (2001, 2004), metrics=["TMK"]).first()
    assert (row.TMK, row.TMK_normal, row.TMK_diff) == (2.0, 2.5, -0.5)


def test_station_without_slice_or_normal(clean):
    assert deviation.deviations(clean, 1990, (2001, 2004)).count() == 0
    row = deviation.deviations(clean, 2004, (1961, 1990), metrics=["TMK", "RSK"]).first()
    assert (row.TMK, row.TMK_normal, row.TMK_diff, row.RSK_normal) == (4.0, None, None, None)


def test_all_periods_at_once(clean):
    periods = ["2001-2002", "2002-2005", "1961-1990"]
    got = {r.Period: r for r in normals.normals_of_periods(clean, periods).collect()}
    assert set(got) == {"2001-2002", "2002-2005"}
    for period in got:
        one = normals.normals(clean, period).first()
        assert all(got[period][m] == one[m] for m in normals.METRICS)


def test_record_averages_leave_out_empty_years(spark):
    schema = "station_id string, Jahr int, RSK double, SDK double, Regentage bigint, Schneetage bigint, Heiteretage bigint, Truebetage bigint"
    rows = [("0001", 2001, 0.0, 10.0, 0, 0, 1, 2), ("0001", 2002, 8.0, 0.0, 4, 2, 9, 9), ("0001", 2003, 4.0, 20.0, 2, 0, 3, 4)]
    df = spark.createDataFrame(rows, schema)
    rain, sun = slices.precipitation_record(df).first(), slices.sun_record(df).first()
    assert (rain.Avg_RSK_sum, rain.Avg_Regentage, rain.Avg_Schneetage, rain.first_year) == (6.0, 3.0, 1.0, 2002)
    assert (sun.Avg_SDK_sum, sun.Avg_Heiteretage, sun.Avg_Truebetage, sun.last_year) == (15.0, 2.0, 3.0, 2003)


def test_table_of_a_thousand_periods(spark, raw_days):
    rows = [
        (f"{s:04d}", f"{y}-{m:02d}-10", {"TMK": s + y % 7 + m / 10, "RSK": m / 3, "SDK": None if y == 1995 else 1.0, "NM": 1.0})
        for s in (1, 2) for y in (1991, 1992, 1995, 1996, 2003) if (s, y) != (2, 2003) for m in range(1, 13)
    ]
    days = cleaning.clean(raw_days(rows))
    periods = [(f"{a}-{b}", a, b) for a in range(1970, 2012) for b in range(a - 1, a + 24)] + [("none", None, 2000)]
    found = normals.normals_of_period_table(days, spark.createDataFrame(periods, "Period string, first_year int, last_year int"))
    by_key = {(r.station_id, r.Period): r for r in found.collect()}
    listed = [p for p in periods if p[1] is not None and p[1] <= p[2]][::40]
    expected = normals.normals_of_periods(days, [(a, b) for _, a, b in listed])
    for r in expected.collect():
        assert by_key[r.station_id, r.Period].asDict() == r.asDict()
    names = {p for p, _, _ in listed}
    assert {k for k in by_key if k[1] in names} == {(r.station_id, r.Period) for r in expected.collect()}
    assert len(periods) > 1000 and len(by_key) > 900 and ("0002", "2003-2003") not in by_key
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_table_of_periods_without_rows(spark, raw_days):
    periods = spark.createDataFrame([("a", 1990, 1999)], "Period string, first_year int, last_year int")
    assert normals.normals_of_period_table(cleaning.clean(raw_days([])), periods).collect() == []


def test_periods_of_equal_years_are_worked_out_once_and_their_rows_spread_over_tasks(spark, raw_days, monkeypatch):
    monkeypatch.setattr(normals, "ROWS_PER_TASK", 50)
    days = cleaning.clean(raw_days([(f"{s:04d}", f"2000-{m:02d}-10", {"TMK": s + m / 7}) for s in range(1, 5) for m in range(1, 13)]))
    periods = spark.createDataFrame([(f"p{i}", 1990 + i % 3, 2005) for i in range(200)], "Period string, first_year int, last_year int")
    finished = []

    def finish(values):
        finished.append(values.count())
        return values

    found = normals.normals_of_period_table(days, periods, finish=finish)
    assert finished == [4]  # all bounds are one pair within the record
    assert found.count() == 4 * 200 and found.select("station_id", "Period").distinct().count() == 4 * 200
    assert found.rdd.getNumPartitions() == 4 * 200 // 50
