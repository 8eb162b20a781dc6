"""The questions a user can ask, each answered by one lazy DataFrame for all stations.

Modes keep their established names: ``einMonat`` (one month of a year), ``alleMonate`` (one year) and ``all`` (the
whole record, optionally of one calendar month).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from klimawerk.operators import deviation, normals, partials, running, search, slices, sunshine, tables
from klimawerk.operators.cleaning import clean
from klimawerk.operators.reshape import temperatures_long
from klimawerk.operators.yearly import yearly
from klimawerk.schema import DEFAULT_STATION, PERIODS
from klimawerk.sources.geojson import read_feature_collections, station_points
from klimawerk.sources.materialised import read_clean, write_clean
from klimawerk.sources.station_files import read_station_files
from klimawerk.sources.versions import StationStore
from klimawerk.streaming import live

MONTH, YEAR, RECORD = "einMonat", "alleMonate", "all"


class ClimateEngine:
    def __init__(self, clean_days: DataFrame, stations: DataFrame | None = None, monthly: DataFrame | None = None):
        """With ``monthly``, the monthly partial sums of the days, yearly rows, normals and deviations need no daily rows."""
        self.days = clean_days
        self.stations = stations
        self.monthly = monthly

    @classmethod
    def from_station_files(
        cls, spark: SparkSession, paths: str | list[str], stations_path: str | None = None, store: str | None = None,
        replace: bool = False, overlapping: bool = False, multiline: bool = True,
    ) -> ClimateEngine:
        """Read and clean station files. With ``store`` the cleaned table is written there and read back.

        A table that exists there is an error unless ``replace`` is set; ``open`` reads it. ``overlapping`` keeps days that
        several files repeat once; ``multiline=False`` reads stations with one GeoJSON document per line.
        """
        days = clean(read_station_files(spark, paths, overlapping))
        if store is not None:
            write_clean(days, store, replace)
            days = read_clean(spark, store)
        return cls(days, _points(spark, stations_path, multiline))

    @classmethod
    def open(
        cls, spark: SparkSession, store: str, stations_path: str | None = None, multiline: bool = True
    ) -> ClimateEngine:
        """Read a cleaned table that was written before; nothing is cleaned again."""
        return cls(read_clean(spark, store), _points(spark, stations_path, multiline))

    @classmethod
    def from_store(
        cls, spark: SparkSession, path: str, version: int | None = None, stations_path: str | None = None, multiline: bool = True
    ) -> ClimateEngine:
        """Read the current or a given version of a ``StationStore``; stations that are added later belong to later versions."""
        store = StationStore(spark, path)
        version = version or store.versions()[-1]  # both tables of one version, whatever is added meanwhile
        return cls(store.read(version), _points(spark, stations_path, multiline), store.read_months(version))

    def for_station(self, station_id: str = DEFAULT_STATION) -> ClimateEngine:
        """The same engine restricted to one station."""
        monthly = None if self.monthly is None else slices.select_days(self.monthly, station_id=station_id)
        return ClimateEngine(slices.select_days(self.days, station_id=station_id), self.stations, monthly)

    # Choices

    def bounds(self) -> DataFrame:
        return slices.bounds(self.days)

    def months(self) -> DataFrame:
        return slices.available_months(self.days)

    @staticmethod
    def periods() -> list[str]:
        return list(PERIODS)

    # Slices

    def slice(self, mode: str, year: int | None = None, month: int | None = None) -> DataFrame:
        """Daily rows of a month or year, or the yearly rows of the record."""
        _check(mode, year, month)
        if mode == RECORD:
            return yearly(self.days, month) if self.monthly is None else partials.yearly(self.monthly, month)
        return slices.select_days(self.days, year=year, month=month if mode == MONTH else None)

    def _with_normals(self, mode: str, year: int, month: int | None, period: str | tuple[int, int]) -> DataFrame:
        day_normals = normals.daily_normals(self.days, period)
        if mode == MONTH:
            return normals.join_month_normals(self.slice(mode, year, month), day_normals, year, month)
        return normals.join_year_normals(self.slice(mode, year), day_normals)

    # Series

    def temperature_series(
        self, mode: str, year: int | None = None, month: int | None = None, period: str | tuple[int, int] = PERIODS[0]
    ) -> DataFrame:
        if mode == RECORD:
            return self.slice(mode, month=month).filter(slices.nonzero("TMK", "TXK", "TNK"))
        return self._with_normals(mode, year, month, period)

    def temperature_strip(self, mode: str, year: int | None = None, month: int | None = None) -> DataFrame:
        """Long form: one row per day or year and temperature."""
        long = temperatures_long(self.slice(mode, year, month), ["station_id", "Day"])
        return long.filter(F.col("value") != 0) if mode == RECORD else long

    def precipitation_series(
        self,
        mode: str,
        year: int | None = None,
        month: int | None = None,
        period: str | tuple[int, int] = PERIODS[0],
        null_policy: str = "propagate",
    ) -> DataFrame:
        if mode == RECORD:
            return running.yearly_precipitation_course(self.slice(mode, month=month))
        return running.precipitation_course(self._with_normals(mode, year, month, period), null_policy)

    def precipitation_strip(self, mode: str, year: int | None = None, month: int | None = None) -> DataFrame:
        rows = self.slice(mode, year, month)
        if mode == RECORD:
            rows = rows.filter(slices.nonzero("RSK"))
        return rows.select("station_id", "Day", "RSK")

    def sunshine_series(self, mode: str, year: int | None = None, month: int | None = None) -> DataFrame:
        if mode == RECORD:
            return running.yearly_sunshine_course(self.slice(mode, month=month))
        return running.sunshine_course(self.slice(mode, year, month))

    def possible_sunshine(self, mode: str, year: int, month: int | None = None) -> DataFrame:
        """Measured beside possible sunshine of a month or year; the default position without a station dimension."""
        if mode == RECORD:
            raise ValueError("possible sunshine is per day; choose a month or a year")
        return sunshine.sunshine_overlay(
            self.slice(mode, year, month), self.stations, year, month if mode == MONTH else None
        )

    def cloud_strip(self, mode: str, year: int | None = None, month: int | None = None) -> DataFrame:
        rows = self.slice(mode, year, month)
        if mode == RECORD:
            rows = rows.filter(slices.nonzero("SDK"))
        return rows.select("station_id", "Day", "NM")

    # Tiles

    def temperature_tiles(self, mode, year=None, month=None, period=PERIODS[0]) -> DataFrame:
        if mode == RECORD:
            return slices.temperature_record(self.slice(mode, month=month))
        return self._deviations(mode, year, month, period, deviation.TEMPERATURE)

    def precipitation_tiles(self, mode, year=None, month=None, period=PERIODS[0]) -> DataFrame:
        if mode == RECORD:
            return slices.precipitation_record(self.slice(mode, month=month))
        return self._deviations(mode, year, month, period, deviation.PRECIPITATION)

    def sunshine_tiles(self, mode, year=None, month=None, period=PERIODS[0]) -> DataFrame:
        if mode == RECORD:
            return slices.sun_record(self.slice(mode, month=month))
        return self._deviations(mode, year, month, period, deviation.SUNSHINE)

    def _deviations(self, mode, year, month, period, metrics) -> DataFrame:
        _check(mode, year, month)
        month = month if mode == MONTH else None
        if self.monthly is None:
            return deviation.deviations(self.days, year, period, month, metrics)
        return deviation.deviations_of_years(partials.year_metrics(self.monthly, metrics, month), year, period, metrics)

    def normals(self, periods: DataFrame, month: int | None = None) -> DataFrame:
        """All normals of a table of periods (Period, first_year, last_year)."""
        if self.monthly is None:
            return normals.normals_of_period_table(self.days, periods, month)
        return normals.period_table_of_years(partials.year_metrics(self.monthly, normals.METRICS, month), periods)

    # Tables

    def table(self, kind: str = "daily", month: int | None = None) -> DataFrame:
        return tables.averaged_table(self.days, month) if kind == "averaged" else tables.daily_table(self.days)

    def search(self, tree: dict, kind: str = "daily", month: int | None = None) -> DataFrame:
        """Rows of a table that meet a tree of conditions."""
        return search.search_builder(self.table(kind, month), tree)

    def text_search(self, text: str, kind: str = "daily", month: int | None = None) -> DataFrame:
        """Rows of a table that contain every word of the text."""
        return search.text_search(self.table(kind, month), text)

    def top_k(self, column: str, k: int = 10, kind: str = "daily", month: int | None = None) -> DataFrame:
        """The ``k`` rows of each station with the largest values; equal ones by date or year."""
        table = self.table(kind, month)
        order = [F.desc_nulls_last(f"`{column}`"), F.asc(f"`{table.columns[1]}`")]
        return search.top_k(table, order, k)

    @staticmethod
    def latest(landed: DataFrame) -> DataFrame:
        """Newest live observation of each station among landed payloads."""
        return live.latest(live.normalise(landed))


def _points(spark: SparkSession, path: str | None, multiline: bool) -> DataFrame | None:
    return station_points(read_feature_collections(spark, path, multiline)) if path else None


def _check(mode: str, year: int | None, month: int | None) -> None:
    if mode not in (MONTH, YEAR, RECORD):
        raise ValueError(f"unknown mode: {mode}")
    if mode != RECORD and year is None:
        raise ValueError(f"mode {mode} needs a year")
    if mode == MONTH and month is None:
        raise ValueError(f"mode {mode} needs a month")
