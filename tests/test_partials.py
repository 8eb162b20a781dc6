"""Monthly partial sums give the rows that daily rows give, and their plans do not read daily rows."""

import pytest

from klimawerk.operators import cleaning, deviation, normals, partials, slices
from klimawerk.operators.yearly import yearly
from klimawerk.plans.engine import ClimateEngine
from klimawerk.session import fresh_folder
from klimawerk.sources.versions import StationStore


@pytest.fixture(scope="module")
def raw(spark):
    from klimawerk.workload import inputs
    return inputs.daily(spark, "/root/testdata/sf0.001")


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("month", [None, 2])
def test_same_rows_as_from_days(raw, month):
    days = cleaning.clean(raw)
    months = partials.monthly_partials(days).cache()
    assert rows(partials.yearly(months, month)) == rows(yearly(days, month))
    of_years = partials.year_metrics(months, normals.METRICS, month)
    assert rows(of_years) == rows(normals.year_metrics(days, month=month))
    assert rows(deviation.deviations_of_years(of_years, 1999, (1995, 1998))) == rows(deviation.deviations(days, 1999, (1995, 1998), month))
    for ours, theirs in (
        (partials.temperature_totals, slices.temperature_totals), (partials.precipitation_totals, slices.precipitation_totals),
        (partials.sun_totals, slices.sun_totals),
    ):
        assert rows(ours(slices.select_days(months, year=1999, month=month))) == rows(theirs(slices.select_days(days, year=1999, month=month)))


def test_any_split_of_a_month_merges_to_the_same(spark, raw_days):
    days = cleaning.clean(raw_days([
        ("0001", f"2001-{m:02d}-{d:02d}", {"TMK": d / 8, "RSK": None if d % 2 else d / 10, "TXK": 20.0 + d}) for m in range(1, 13) for d in range(1, 28)
    ]))
    whole = partials.monthly_partials(days)
    split = partials.monthly_partials(days.where("Tag < 9")).union(partials.monthly_partials(days.where("Tag >= 9")))
    assert split.count() == 2 * whole.count()
    assert rows(partials.yearly(split)) == rows(partials.yearly(whole)) == rows(yearly(days))


def test_engine_of_a_store_answers_from_months(spark, raw):
    store = StationStore(spark, fresh_folder(spark, "test-months"))
    store.put(raw.where("station_id < '0003'"))
    store.put(raw.where("station_id >= '0002'"))
    engine, plain = ClimateEngine.from_store(spark, store.path), ClimateEngine(cleaning.clean(raw))
    periods = spark.createDataFrame([("a", 1995, 1998), ("b", 1980, 2010)], "Period string, first_year int, last_year int")
    for ask in (
        lambda e: e.temperature_tiles("alleMonate", 1999, period=(1995, 1998)), lambda e: e.sunshine_tiles("einMonat", 1999, 7, (1995, 1998)),
        lambda e: e.precipitation_tiles("all"), lambda e: e.slice("all", month=3), lambda e: e.normals(periods),
        lambda e: e.for_station("0002").temperature_tiles("all"),
    ):
        answer = ask(engine)
        assert rows(answer) == rows(ask(plain))
        read = {f.split("/")[-2] for f in answer.inputFiles()}
        assert "months" in read and not any(folder.startswith("Jahr=") for folder in read)
