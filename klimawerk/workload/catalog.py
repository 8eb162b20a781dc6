"""Registered queries: name -> function of (session, table folder). Every one runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from klimawerk.functions.dates import month_label
from klimawerk.functions.measures import nearest
from klimawerk.operators import (
    cleaning, deviation, geo, layers, normals, partials, precipitation, running, search, slices, spells, sunshine, tables,
)
from klimawerk.operators import stations as station_dim
from klimawerk.operators.reshape import temperatures_long
from klimawerk.operators.yearly import yearly
from klimawerk.schema import MEASURES, PERIODS, THRESHOLD_DAYS
from klimawerk.session import fresh_folder
from klimawerk.sources import geojson, station_files, versions
from klimawerk.streaming import live
from klimawerk.workload import inputs

# Parameters; the derived record has complete years 1995 to 2000.
YEAR, MONTH, LEAP_MONTH = 2000, 7, 2
PERIOD = (1995, 1998)
ALL_PERIODS = [*PERIODS, "1995-1998", "1997-2000"]
SEARCH_TREE = {
    "logic": "OR",
    "criteria": [
        {"column": "Tageshöchsttemperatur", "condition": ">", "value": [30.0]},
        {
            "logic": "AND",
            "criteria": [
                {"column": "Niederschlag", "condition": "between", "value": [20.0, 25.0]},
                {"column": "Sonnenscheindauer", "condition": "!null"},
                {"column": "Datum", "condition": "contains", "value": ["-07-"]},
            ],
        },
    ],
}
SEARCH_TEXT = "-07-1 0.0"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def rounded(result: DataFrame) -> DataFrame:
    """Doubles are compared to six decimals."""
    return result.withColumns({name: nearest(f"`{name}`", 6) for name, kind in result.dtypes if kind == "double"})


def query(fn: Query) -> Query:
    """Register a query and round its result."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(fn(spark, sf_dir))

    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def query_rounding(fn: Query) -> Query:
    """Register a query that rounds by itself, where rows are repeated after that."""
    QUERIES[fn.__name__] = fn
    return fn


# Sources and sinks


@query
def src_dwd_csv(spark, sf_dir):
    return inputs.station_files(spark, sf_dir).select("station_id", "MESS_DATUM", *MEASURES)


@query
def src_station_counts(spark, sf_dir):
    raw = inputs.station_files(spark, sf_dir)
    return station_files.loaded_counts(raw, cleaning.keep_complete_years(cleaning.add_date_parts(raw)))


@query
def src_loaded_total(spark, sf_dir):
    raw = inputs.station_files(spark, sf_dir)
    return station_files.loaded_total(cleaning.keep_complete_years(cleaning.add_date_parts(raw)))


@query
def src_station_id(spark, sf_dir):
    return inputs.station_files(spark, sf_dir).groupBy("station_id", "STATIONS_ID").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def src_rejected_rows(spark, sf_dir):
    landed = station_files.land_station_files(
        spark, f"{inputs.flawed_station_files(spark, sf_dir)}/*", fresh_folder(spark, "landed"), max_share=0.5
    )
    return landed.rejected.groupBy("station_id", "reason").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def src_landed_rows(spark, sf_dir):
    landed = station_files.land_station_files(
        spark, f"{inputs.flawed_station_files(spark, sf_dir)}/*", fresh_folder(spark, "landed"), max_share=0.5
    )
    return landed.days.select("station_id", "MESS_DATUM", *MEASURES)


@query
def src_versioned_store(spark, sf_dir):
    """All stations at first with wrong temperatures at every second one, then these anew: the last version has no wrong row."""
    raw = inputs.daily(spark, sf_dir)
    odd = F.col("station_id").cast("bigint") % 2 == 1
    store = versions.StationStore(spark, fresh_folder(spark, "store"))
    store.put(raw.withColumn("TMK", F.when(odd, F.col("TMK") + 40).otherwise(F.col("TMK"))))
    store.put(raw.where(odd))
    return store.read().select("station_id", "Date", *MEASURES)


@query
def src_stations_geojson(spark, sf_dir):
    folder = fresh_folder(spark, "points")
    inputs.point_documents(spark, sf_dir).write.text(folder)
    return geojson.station_points(geojson.read_feature_collections(spark, folder, multiline=False))


@query
def src_stations_large_geojson(spark, sf_dir):
    folder = fresh_folder(spark, "large-points")
    inputs.large_point_documents(spark, sf_dir).write.text(folder)
    return geojson.station_points(geojson.read_large_collections(spark, folder))


@query
def snk_roundtrip(spark, sf_dir):
    table = tables.averaged_table(inputs.cleaned(spark, sf_dir))
    folder = fresh_folder(spark, "export")
    station_files.export_table(table, folder)
    return station_files.read_export(spark, folder, table.schema)


@query
def set_union_stations(spark, sf_dir):
    # Two reads of different station files, by the last digit of their names.
    parts = [inputs.station_files(spark, sf_dir, f"*[{digits}].txt") for digits in ("02468", "13579")]
    return cleaning.add_date_parts(station_files.union_stations(parts)).select("station_id", "Date", *MEASURES)


# Cleaning and projections


@query
def prj_date_parts(spark, sf_dir):
    days = cleaning.add_flags(cleaning.add_date_parts(inputs.daily(spark, sf_dir)))
    return days.select("station_id", "MESS_DATUM", "Date", "Jahr", "Monat", "Tag", "Day", "Date_without_year")


@query
def prj_month_label(spark, sf_dir):
    days = cleaning.add_date_parts(inputs.daily(spark, sf_dir))
    return days.groupBy("station_id", "Monat").agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "Monat_german", month_label(F.col("Monat"))
    )


@query
def prj_threshold_days(spark, sf_dir):
    return inputs.cleaned(spark, sf_dir).select("station_id", "Date", *[name for name, *_ in THRESHOLD_DAYS])


@query
def cln_complete_years(spark, sf_dir):
    days = cleaning.keep_complete_years(cleaning.add_date_parts(inputs.daily(spark, sf_dir)))
    return days.groupBy("station_id", "Jahr").agg(F.count(F.lit(1)).alias("n_rows"))


def _valid(spark, sf_dir):
    return cleaning.keep_complete_years(cleaning.add_date_parts(inputs.daily(spark, sf_dir)))


@query
def cln_missing_counts(spark, sf_dir):
    return cleaning.missing_counts(_valid(spark, sf_dir))


@query
def cln_dayofyear_mean(spark, sf_dir):
    return cleaning.day_of_year_means(_valid(spark, sf_dir))


@query
def cln_gapfill(spark, sf_dir):
    filled = cleaning.fill_gaps(cleaning.add_date_parts(inputs.daily(spark, sf_dir)))
    return filled.select("station_id", "Date", *MEASURES)


# Slices, dimensions and bounds


@query
def flt_year(spark, sf_dir):
    return slices.select_days(inputs.cleaned(spark, sf_dir), year=YEAR).select("station_id", "Date", *MEASURES)


@query
def flt_month(spark, sf_dir):
    days = slices.select_days(inputs.cleaned(spark, sf_dir), year=YEAR, month=MONTH)
    return days.select("station_id", "Date", *MEASURES)


@query
def flt_zero_temp(spark, sf_dir):
    rows = yearly(inputs.cleaned(spark, sf_dir), MONTH).filter(slices.nonzero("TMK", "TXK", "TNK"))
    return rows.select("station_id", "Jahr", "TNK", "TMK", "TXK")


@query
def flt_station(spark, sf_dir):
    return station_dim.find_station(inputs.stations(spark, sf_dir), "Station 0001", "0001")


@query
def jn_station(spark, sf_dir):
    joined = station_dim.with_station(inputs.cleaned(spark, sf_dir), inputs.stations(spark, sf_dir))
    return joined.select("station_id", "Date", "TMK", "name", "height", "lon", "lat")


@query
def jn_station_semi(spark, sf_dir):
    return station_dim.stations_with_data(inputs.stations(spark, sf_dir), inputs.cleaned(spark, sf_dir))


@query
def agg_bounds(spark, sf_dir):
    return slices.bounds(inputs.cleaned(spark, sf_dir))


@query
def agg_distinct_months(spark, sf_dir):
    return slices.available_months(inputs.cleaned(spark, sf_dir))


# Yearly rollup


@query
def agg_yearly(spark, sf_dir):
    return yearly(inputs.cleaned(spark, sf_dir))


@query
def agg_yearly_month(spark, sf_dir):
    return yearly(inputs.cleaned(spark, sf_dir), MONTH)


@query
def srt_yearly(spark, sf_dir):
    return slices.sorted_output(yearly(inputs.cleaned(spark, sf_dir)), "Jahr", "station_id").select(
        "station_id", "Jahr", "TMK", "RSK"
    )


# Normals and deviations


@query
def nrm_mean_over_time(spark, sf_dir):
    return normals.mean_over_time(inputs.cleaned(spark, sf_dir), "TMK", PERIOD)


@query
def nrm_mean_over_time_month(spark, sf_dir):
    return normals.mean_over_time(inputs.cleaned(spark, sf_dir), "TXK", PERIOD, month=MONTH)


@query
def nrm_sum_over_time(spark, sf_dir):
    return normals.mean_over_time(inputs.cleaned(spark, sf_dir), "SDK", PERIOD, is_day=True)


@query
def nrm_sum_over_time_month(spark, sf_dir):
    return normals.mean_over_time(inputs.cleaned(spark, sf_dir), "RSK", PERIOD, month=MONTH, is_day=True)


@query
def nrm_all_metrics(spark, sf_dir):
    return normals.normals(inputs.cleaned(spark, sf_dir), PERIOD)


@query
def nrm_all_periods(spark, sf_dir):
    return normals.normals_of_periods(inputs.cleaned(spark, sf_dir), ALL_PERIODS)


@query_rounding
def nrm_period_table(spark, sf_dir):
    return normals.normals_of_period_table(inputs.cleaned(spark, sf_dir), inputs.periods(spark, sf_dir), finish=rounded)


@query
def nrm_daily(spark, sf_dir):
    return normals.daily_normals(inputs.cleaned(spark, sf_dir), PERIOD)


def _year_with_normals(spark, sf_dir):
    clean = inputs.cleaned(spark, sf_dir)
    return normals.join_year_normals(slices.select_days(clean, year=YEAR), normals.daily_normals(clean, PERIOD))


@query
def nrm_join_year(spark, sf_dir):
    return _year_with_normals(spark, sf_dir).select("station_id", "Date", "TMK", "RSK", "Average_TMK", "Average_RSK")


@query
def nrm_join_month(spark, sf_dir):
    clean = inputs.cleaned(spark, sf_dir)
    days = slices.select_days(clean, year=YEAR, month=LEAP_MONTH)
    joined = normals.join_month_normals(days, normals.daily_normals(clean, PERIOD), YEAR, LEAP_MONTH)
    return joined.select("station_id", "Date", "TMK", "RSK", "Average_TMK", "Average_RSK")


@query
def dev_temp_year(spark, sf_dir):
    return deviation.deviations(inputs.cleaned(spark, sf_dir), YEAR, PERIOD, metrics=deviation.TEMPERATURE)


@query
def dev_temp_month(spark, sf_dir):
    return deviation.deviations(inputs.cleaned(spark, sf_dir), YEAR, PERIOD, MONTH, deviation.TEMPERATURE)


@query
def dev_precip_year(spark, sf_dir):
    return deviation.deviations(inputs.cleaned(spark, sf_dir), YEAR, PERIOD, metrics=deviation.PRECIPITATION)


@query
def dev_precip_month(spark, sf_dir):
    return deviation.deviations(inputs.cleaned(spark, sf_dir), YEAR, PERIOD, MONTH, deviation.PRECIPITATION)


@query
def dev_sun_year(spark, sf_dir):
    return deviation.deviations(inputs.cleaned(spark, sf_dir), YEAR, PERIOD, metrics=deviation.SUNSHINE)


@query
def dev_sun_month(spark, sf_dir):
    return deviation.deviations(inputs.cleaned(spark, sf_dir), YEAR, PERIOD, MONTH, deviation.SUNSHINE)


@query
def dev_all_year(spark, sf_dir):
    return deviation.deviations(inputs.cleaned(spark, sf_dir), YEAR, PERIOD)


# Totals


@query
def tile_temp(spark, sf_dir):
    return slices.temperature_totals(slices.select_days(inputs.cleaned(spark, sf_dir), year=YEAR))


@query
def tile_precip(spark, sf_dir):
    return slices.precipitation_totals(slices.select_days(inputs.cleaned(spark, sf_dir), year=YEAR))


@query
def tile_sun(spark, sf_dir):
    return slices.sun_totals(slices.select_days(inputs.cleaned(spark, sf_dir), year=YEAR))


def _july(spark, sf_dir):
    return slices.select_days(inputs.cleaned(spark, sf_dir), year=YEAR, month=MONTH)


@query
def tile_temp_month(spark, sf_dir):
    return slices.temperature_totals(_july(spark, sf_dir))


@query
def tile_precip_month(spark, sf_dir):
    return slices.precipitation_totals(_july(spark, sf_dir))


@query
def tile_sun_month(spark, sf_dir):
    return slices.sun_totals(_july(spark, sf_dir))


@query
def tile_temp_all(spark, sf_dir):
    return slices.temperature_record(yearly(inputs.cleaned(spark, sf_dir)))


@query
def tile_precip_all(spark, sf_dir):
    return slices.precipitation_record(yearly(inputs.cleaned(spark, sf_dir)))


@query
def tile_sun_all(spark, sf_dir):
    return slices.sun_record(yearly(inputs.cleaned(spark, sf_dir)))


# The same from monthly partial sums


def _months(spark, sf_dir, month=None):
    return slices.select_days(inputs.months(spark, sf_dir), year=YEAR, month=month)


@query
def prt_yearly(spark, sf_dir):
    return partials.yearly(inputs.months(spark, sf_dir))


@query
def prt_normals(spark, sf_dir):
    return normals.periods_of_years(partials.year_metrics(inputs.months(spark, sf_dir), normals.METRICS), ALL_PERIODS)


@query_rounding
def prt_period_table(spark, sf_dir):
    per_year = partials.year_metrics(inputs.months(spark, sf_dir), normals.METRICS, month=MONTH)
    return normals.period_table_of_years(per_year, inputs.periods(spark, sf_dir), finish=rounded)


@query
def prt_deviations(spark, sf_dir):
    return deviation.deviations_of_years(partials.year_metrics(inputs.months(spark, sf_dir), normals.METRICS), YEAR, PERIOD)


@query
def prt_temp_month(spark, sf_dir):
    return partials.temperature_totals(_months(spark, sf_dir, MONTH))


@query
def prt_precip_year(spark, sf_dir):
    return partials.precipitation_totals(_months(spark, sf_dir))


@query
def prt_sun_month(spark, sf_dir):
    return partials.sun_totals(_months(spark, sf_dir, MONTH))


# Windows


@query
def win_cumsum_precip(spark, sf_dir):
    days = running.precipitation_course(_year_with_normals(spark, sf_dir))
    return days.select("station_id", "Date", "RSK", "Cumulative_RSK")


@query
def win_cumsum_normal(spark, sf_dir):
    days = _year_with_normals(spark, sf_dir)
    course = running.precipitation_course(days).select("station_id", "Date", "Average_RSK", "Cumulative_avg_RSK")
    return course


@query
def win_cumsum_normal_skip(spark, sf_dir):
    days = running.precipitation_course(_year_with_normals(spark, sf_dir), null_policy="skip")
    return days.select("station_id", "Date", "Average_RSK", "Cumulative_avg_RSK")


@query
def win_cumsum_sun(spark, sf_dir):
    return running.sunshine_course(inputs.cleaned(spark, sf_dir)).select("station_id", "Date", "SDK", "Cumulative_SDK")


@query
def win_cumsum_yearly(spark, sf_dir):
    return running.yearly_precipitation_course(yearly(inputs.cleaned(spark, sf_dir))).select(
        "station_id", "Jahr", "RSK", "Cumulative_RSK"
    )


@query
def win_cumsum_yearly_sun(spark, sf_dir):
    return running.yearly_sunshine_course(yearly(inputs.cleaned(spark, sf_dir))).select(
        "station_id", "Jahr", "SDK", "Cumulative_SDK"
    )


@query
def win_spells(spark, sf_dir):
    return spells.longest_spells(inputs.cleaned(spark, sf_dir))


@query
def win_warm_cold(spark, sf_dir):
    return spells.warm_cold_segments(_year_with_normals(spark, sf_dir))


# Tables and reshape


@query
def tbl_daily(spark, sf_dir):
    return tables.daily_table(inputs.cleaned(spark, sf_dir))


@query
def tbl_averaged_year(spark, sf_dir):
    return tables.averaged_table(inputs.cleaned(spark, sf_dir))


@query
def tbl_averaged_month(spark, sf_dir):
    return tables.averaged_table(inputs.cleaned(spark, sf_dir), MONTH)


@query
def tbl_search_builder(spark, sf_dir):
    return search.search_builder(tables.daily_table(inputs.cleaned(spark, sf_dir)), SEARCH_TREE)


@query
def tbl_text_search(spark, sf_dir):
    return search.text_search(tables.daily_table(inputs.cleaned(spark, sf_dir)), SEARCH_TEXT)


@query
def tbl_top_k(spark, sf_dir):
    table = tables.daily_table(inputs.cleaned(spark, sf_dir))
    order = [F.desc_nulls_last("Tageshöchsttemperatur"), F.asc("Datum")]
    return search.top_k(table, order).select("station_id", "Rang", "Datum", "Tageshöchsttemperatur")


@query
def rsh_temp_long(spark, sf_dir):
    days = slices.select_days(inputs.cleaned(spark, sf_dir), year=YEAR)
    return temperatures_long(days, ["station_id", "Day"])


@query
def rsh_temp_long_yearly(spark, sf_dir):
    long = temperatures_long(yearly(inputs.cleaned(spark, sf_dir)), ["station_id", "Jahr", "Day"])
    return long.filter(F.col("value") != 0)


# Sunshine and scalar functions


@query
def sun_daylength(spark, sf_dir):
    days = sunshine.day_lengths(inputs.supplier_points(spark, sf_dir), YEAR)
    return days.select("station_id", "date", "sunshine_duration", "Monat")


@query
def sun_month(spark, sf_dir):
    days = sunshine.day_lengths(inputs.supplier_points(spark, sf_dir), YEAR, MONTH)
    return days.select("station_id", "date", "sunshine_duration", "Monat_german")


@query
def sun_overlay(spark, sf_dir):
    days = slices.select_days(inputs.cleaned(spark, sf_dir), year=YEAR)
    # Every fourth station is missing from the dimension.
    located = inputs.stations(spark, sf_dir).filter(F.col("number").cast("bigint") % 4 != 1)
    return sunshine.sunshine_overlay(days, located, YEAR)


@query
def fn_precip_classes(spark, sf_dir):
    return precipitation.intensity_classes(inputs.cleaned(spark, sf_dir))


@query
def fn_precip_record_scale(spark, sf_dir):
    return precipitation.yearly_log_scale(yearly(inputs.cleaned(spark, sf_dir)))


# Shapes and layers


@query
def geo_bbox(spark, sf_dir):
    collections = geojson.parse_feature_collections(inputs.outline_documents(spark, sf_dir))
    return geo.bounding_box(geojson.outline_rings(collections))


@query
def geo_boundary_edges(spark, sf_dir):
    folder = fresh_folder(spark, "outlines")
    inputs.outline_documents(spark, sf_dir).write.text(folder)
    collections = geojson.read_feature_collections(spark, folder, multiline=False)
    return geo.boundary_edges(geojson.outline_rings(collections))


@query
def map_layer_value(spark, sf_dir):
    return layers.layer_values(inputs.layer_readings(spark, sf_dir)).select("layer", "raw", "value", "label")


# Live observations


@query
def live_normalise(spark, sf_dir):
    return live.normalise(inputs.payloads(spark, sf_dir))


@query
def live_latest(spark, sf_dir):
    return live.latest(live.normalise(inputs.payloads(spark, sf_dir)))


@query
def live_wind_rose(spark, sf_dir):
    return live.wind_rose(live.normalise(inputs.payloads(spark, sf_dir)))


@query
def live_bands(spark, sf_dir):
    return live.with_bands(live.normalise(inputs.payloads(spark, sf_dir))).select(
        "station_id", "dt", "temp", "temp_band", "pressure", "pressure_band", "humidity", "humidity_band"
    )


@query
def live_normalise_stream(spark, sf_dir):
    table = fresh_folder(spark, "normalised")
    stream = inputs.payloads(spark, sf_dir, stream=True)
    live.write_normalised(stream, table, fresh_folder(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(table)


@query
def live_latest_stream(spark, sf_dir):
    table = fresh_folder(spark, "latest")
    stream = inputs.payloads(spark, sf_dir, stream=True)
    live.write_latest(stream, table, fresh_folder(spark, "checkpoint")).awaitTermination()
    return live.read_latest(spark, table)
