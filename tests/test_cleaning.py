from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from klimawerk.operators import cleaning
from klimawerk.operators.normals import mean_over_time
from klimawerk.operators.yearly import yearly
from klimawerk.schema import MEASURES


def days(first, last):
    day = date.fromisoformat(first)
    while day <= date.fromisoformat(last):
        yield day
        day += timedelta(days=1)


@pytest.fixture
def gap_frame(raw_days):
    """2001 misses 59 days, 2002 misses 60, 2004 has only ten months."""
    rows = []
    for day in days("2001-01-01", "2004-10-31"):
        nth = day.timetuple().tm_yday
        value = {2001: 2, 2002: 4, 2003: 6, 2004: 100}[day.year]
        if (day.year == 2001 and nth <= 59) or (day.year == 2002 and nth <= 60):
            value = -999
        rows.append(("0001", day, {"SDK": value}))
    return raw_days(rows)


def test_gap_fill_and_normals(gap_frame):
    clean = cleaning.clean(gap_frame).cache()
    sums = {r.Jahr: r.SDK for r in yearly(clean).collect()}
    assert sums == {2001: 966.0, 2002: 0.0, 2003: 2190.0}
    assert clean.filter("Jahr = 2002 and SDK is not null").count() == 0
    of_sums = mean_over_time(clean, "SDK", (2001, 2003), is_day=True).first().Average_column
    of_means = mean_over_time(clean, "SDK", "2001-2003").first().Average_column
    assert of_sums == 1052.0
    assert of_means == pytest.approx(4.323287671, abs=1e-9)


def test_reports_agree_with_the_one_pass_cleaning(gap_frame):
    valid = cleaning.keep_complete_years(cleaning.add_date_parts(gap_frame))
    counts = {r.Jahr: r.SDK_missing for r in cleaning.missing_counts(valid).collect()}
    assert counts == {2001: 59, 2002: 60, 2003: 0}
    means = cleaning.day_of_year_means(valid).select("station_id", "Monat", "Tag", "SDK_mean")
    filled = cleaning.fill_gaps(cleaning.add_date_parts(gap_frame)).filter("Jahr = 2001")
    joined = filled.join(valid.select("Date", F.col("SDK").alias("before")), "Date").filter("before = -999")
    assert joined.join(means, ["station_id", "Monat", "Tag"]).filter("SDK <> SDK_mean").count() == 0
    assert joined.count() == 59


def full_year(year, **values):
    return [("0001", d, dict(values)) for d in days(f"{year}-01-01", f"{year}-12-31")]


def test_null_is_neither_counted_nor_filled(raw_days):
    rows = full_year(2001, SDK=5)
    rows[9][2]["SDK"] = None
    frame = raw_days(rows)
    clean = cleaning.clean(frame)
    assert clean.filter("SDK is null").count() == 1
    assert cleaning.missing_counts(cleaning.add_date_parts(frame)).first().SDK_missing == 0


def test_sentinel_without_donor_becomes_null(raw_days):
    rows = full_year(2001, SDK=5) + full_year(2002, SDK=5)
    rows[3][2]["SDK"] = rows[368][2]["SDK"] = -999
    clean = cleaning.clean(raw_days(rows))
    assert [str(r.Date) for r in clean.filter("SDK is null").orderBy("Date").collect()] == ["2001-01-04", "2002-01-04"]


def test_completeness_counts_months_with_any_row(raw_days):
    eleven = [("0001", d, {"RSK": -999}) for d in days("2001-01-01", "2001-11-30")]
    ten = [("0002", d, {"RSK": 1}) for d in days("2001-01-01", "2001-10-31")]
    frame = raw_days(eleven + ten)
    assert [r.station_id for r in cleaning.clean(frame).select("station_id").distinct().collect()] == ["0001"]
    assert [r.station_id for r in cleaning.complete_years(cleaning.add_date_parts(frame)).collect()] == ["0001"]


def test_impossible_day_is_dropped(raw_days):
    frame = raw_days(full_year(2001, TMK=1) + [("0001", 20010230, {"TMK": 99})])
    assert cleaning.add_date_parts(frame).filter("Date is null").count() == 1
    assert cleaning.clean(frame).count() == 365


def test_threshold_flags(spark):
    schema = ", ".join(f"{m} double" for m in MEASURES) + ", Date date, Monat int, Tag int"

    def flags(**values):
        row = [values.get(m) for m in MEASURES] + [date(2001, 3, 1), 3, 1]
        return cleaning.add_flags(spark.createDataFrame([row], schema)).first()

    for txk, summer, hot, ice in [(25.0, 1, 0, 0), (30.0, 1, 1, 0), (-0.1, 0, 0, 1), (None, 0, 0, 0)]:
        row = flags(TXK=txk)
        assert (row.Sommertag, row.Hitzetag, row.Eistag) == (summer, hot, ice)
    for tnk, tropical, frost in [(20.0, 1, 0), (0.0, 0, 0), (-0.1, 0, 1), (None, 0, 0)]:
        row = flags(TNK=tnk)
        assert (row.Tropennacht, row.Frosttag) == (tropical, frost)
    assert [flags(SHK_TAG=s).Schneetag for s in (0.0, 1.0, 2.0)] == [0, 0, 1]
    assert [flags(RSK=r).Regentag for r in (0.0, 0.1, None)] == [0, 1, 0]
    assert [(flags(NM=n).Heiterertag, flags(NM=n).Truebertag) for n in (1.5, 1.6, 6.4, 6.5)] == [(1, 0), (0, 0), (0, 0), (0, 1)]
    row = flags()
    assert (str(row.Date_without_year), row.Monat_german) == ("2000-03-01", "März")


def test_properties_on_derived_data(spark):
    from klimawerk.workload import inputs

    from conftest import SMALL

    raw, clean = inputs.daily(spark, SMALL), inputs.cleaned(spark, SMALL)
    has_sentinel = " or ".join(f"{m} = -999" for m in MEASURES)
    assert clean.filter(has_sentinel).count() == 0
    assert clean.count() == cleaning.keep_complete_years(cleaning.add_date_parts(raw)).count()
    assert clean.filter("Hitzetag > Sommertag").count() == 0
    assert clean.filter("TNK <= TXK and Eistag > Frosttag").count() == 0
    assert clean.groupBy("station_id", "Date").count().filter("count > 1").count() == 0


def test_result_does_not_depend_on_partitioning(spark, gap_frame):
    def result(partitions):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            rows = yearly(cleaning.clean(gap_frame.repartition(partitions))).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)
        return sorted(map(tuple, rows))

    assert result(1) == result(8)
