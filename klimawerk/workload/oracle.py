"""The registered queries once more as plain SQL, for comparison in another engine.

Written from the rules, not from the Spark plans: joins and groupings where the library uses windows and the other way
round. Doubles are rounded to six decimals; ``+ 0.0`` turns a negative zero into zero.
"""

from __future__ import annotations

from klimawerk.schema import BAND_RANGES, COMPASS, DAY_COUNTS, MAP_LAYERS, MEASURES, MONTHS, PERIODS, PRECIP_BREAKS
from klimawerk.workload.catalog import ALL_PERIODS, LEAP_MONTH, MONTH, PERIOD, YEAR

START, END = PERIOD


def _s(expression: str) -> str:
    """Sum or mean without last-bit noise."""
    return f"(round({expression}, 9) + 0.0)"


def _near(expression: str, digits: int = 1) -> str:
    """Nearer decimal neighbour, the even one at equal distance."""
    x, scale = f"({expression})", float(10**digits)
    down, up = f"({x} - floor({x} * {scale}) / {scale})", f"(ceil({x} * {scale}) / {scale} - {x})"
    return (
        f"(CASE WHEN {down} < {up} OR ({down} = {up} AND floor({x} * {scale}) % 2 = 0) "
        f"THEN floor({x} * {scale}) / {scale} ELSE ceil({x} * {scale}) / {scale} END + 0.0)"
    )


def _r(expression: str) -> str:
    """A double for comparison."""
    return _near(_s(expression), 6)


def _list(items) -> str:
    return ", ".join(items)


RAW = """
WITH cell AS (
  SELECT l_suppkey // 8 AS reg, CAST(o_orderdate AS DATE) AS d,
    sum(l_orderkey * 7 + l_partkey) AS a, sum(l_partkey) AS b, sum(l_suppkey * 3 + l_linenumber) AS s,
    sum(l_orderkey) AS k
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY 1, 2),
t AS (
  SELECT *, year(d) AS y, month(d) AS m, -90 + 40 * (6 - abs(month(d) - 7)) + a % 150 AS t10 FROM cell),
raw AS (
  SELECT printf('%04d', CAST(reg + 1 AS INT)) AS station_id, CAST(y * 10000 + m * 100 + day(d) AS INT) AS MESS_DATUM,
    CASE WHEN a % 29 = 0 THEN -999.0 ELSE CAST(t10 AS DOUBLE) / 10 END AS TMK,
    CASE WHEN a % 29 = 0 THEN -999.0 ELSE CAST(t10 + b % 80 AS DOUBLE) / 10 END AS TXK,
    CASE WHEN s % 31 = 0 THEN -999.0 ELSE CAST(t10 - s % 80 AS DOUBLE) / 10 END AS TNK,
    CASE WHEN k % 37 = 0 THEN -999.0 WHEN s % 2 = 0 THEN 0.0 ELSE CAST(k % 300 AS DOUBLE) / 10 END AS RSK,
    CASE WHEN (reg + y) % 4 = 0 AND b % 4 = 0 THEN -999.0 WHEN b % 41 = 0 THEN NULL
      ELSE CAST(b % 160 AS DOUBLE) / 10 END AS SDK,
    CASE WHEN m IN (12, 1, 2) THEN CAST(a % 12 AS DOUBLE) ELSE 0.0 END AS SHK_TAG,
    CASE WHEN b % 19 = 0 THEN -999.0 ELSE CAST(b % 81 AS DOUBLE) / 10 END AS NM,
    CASE WHEN k % 43 = 0 THEN -999.0 ELSE CAST(a % 250 AS DOUBLE) / 10 END AS FX,
    CASE WHEN k % 43 = 0 THEN -999.0 ELSE CAST(a % 90 AS DOUBLE) / 10 END AS FM,
    CAST(b % 200 AS DOUBLE) / 10 AS VPM, CAST(9700 + s % 700 AS DOUBLE) / 10 AS PM,
    CAST(30 + k % 71 AS DOUBLE) AS UPM, CAST(t10 - 20 - s % 80 AS DOUBLE) / 10 AS TGK
  FROM t),
days AS (
  SELECT *, CAST(year(Date) AS INT) AS Jahr, CAST(month(Date) AS INT) AS Monat, CAST(day(Date) AS INT) AS Tag
  FROM (SELECT *, CAST(try_strptime(CAST(MESS_DATUM AS VARCHAR), '%Y%m%d') AS DATE) AS Date FROM raw))
"""

VALID = RAW + """,
ok AS (SELECT station_id, Jahr FROM days GROUP BY 1, 2 HAVING count(DISTINCT Monat) >= 11),
valid AS (SELECT days.* FROM days JOIN ok USING (station_id, Jahr))
"""

_LABELS = "[" + _list(f"'{m}'" for m in MONTHS) + "]"
_FLAGS = """
    CASE WHEN RSK >= 0.1 THEN 1 ELSE 0 END AS Regentag,
    CASE WHEN TXK >= 25 THEN 1 ELSE 0 END AS Sommertag,
    CASE WHEN TXK >= 30 THEN 1 ELSE 0 END AS Hitzetag,
    CASE WHEN TNK >= 20 THEN 1 ELSE 0 END AS Tropennacht,
    CASE WHEN TNK < 0 THEN 1 ELSE 0 END AS Frosttag,
    CASE WHEN TXK < 0 THEN 1 ELSE 0 END AS Eistag,
    CASE WHEN SHK_TAG > 1 THEN 1 ELSE 0 END AS Schneetag,
    CASE WHEN NM < 1.6 THEN 1 ELSE 0 END AS Heiterertag,
    CASE WHEN NM > 6.4 THEN 1 ELSE 0 END AS Truebertag
"""

CLEAN = VALID + f""",
missing AS (
  SELECT station_id, Jahr, {_list(f"count(*) FILTER ({c} = -999) AS {c}_n" for c in MEASURES)}
  FROM valid GROUP BY 1, 2),
donor AS (
  SELECT station_id, Monat, Tag, {_list(f"{_s(f'avg({c}) FILTER ({c} <> -999)')} AS {c}_avg" for c in MEASURES)}
  FROM valid GROUP BY 1, 2, 3),
filled AS (
  SELECT v.station_id, v.Date, v.Jahr, v.Monat, v.Tag,
    {_list(f"CASE WHEN {c}_n >= 60 THEN NULL WHEN {c} = -999 THEN {c}_avg ELSE {c} END AS {c}" for c in MEASURES)}
  FROM valid v JOIN missing USING (station_id, Jahr) JOIN donor USING (station_id, Monat, Tag)),
clean AS (
  SELECT *, Date AS Day, make_date(2000, Monat, Tag) AS Date_without_year, {_LABELS}[Monat] AS Monat_german, {_FLAGS}
  FROM filled)
"""

_COUNTS = _list(f"CAST(sum({flag}) AS BIGINT) AS {count}" for flag, count in DAY_COUNTS.items())


def _yearly(name: str, where: str = "") -> str:
    return f""",
{name} AS (
  SELECT station_id, Jahr, {_s('avg(TXK)')} AS TXK, {_s('avg(TMK)')} AS TMK, {_s('avg(TNK)')} AS TNK,
    {_s('coalesce(sum(RSK), 0.0)')} AS RSK, {_s('coalesce(sum(SDK), 0.0)')} AS SDK, {_s('avg(NM)')} AS NM, {_COUNTS}, make_date(Jahr, 1, 1) AS Day
  FROM clean {where} GROUP BY station_id, Jahr)
"""


YEARLY = CLEAN + _yearly("yearly")
YEARLY_MONTH = CLEAN + _yearly("yearly", f"WHERE Monat = {MONTH}")

_YEARLY_COLUMNS = _list(
    ["station_id", "Jahr", "Day"]
    + [f"{_r(c)} AS {c}" for c in ("TXK", "TMK", "TNK", "RSK", "SDK", "NM")]
    + list(DAY_COUNTS.values())
)
_MEASURES_6 = _list(f"{_r(c)} AS {c}" for c in MEASURES)

DAY_NORMALS = CLEAN + f""",
day_normals AS (
  SELECT station_id, Monat AS Month, Tag AS Day, {_s('avg(TMK)')} AS Average_TMK,
    {_s('coalesce(sum(RSK), 0.0) / 30')} AS Average_RSK, {_s('coalesce(sum(SDK), 0.0)')} AS Average_SDK
  FROM clean WHERE Jahr BETWEEN {START} AND {END} AND NOT (Monat = 2 AND Tag = 29)
  GROUP BY 1, 2, 3)
"""

YEAR_NORMALS = DAY_NORMALS + f""",
joined AS (
  SELECT c.station_id, c.Jahr, c.Date, TMK, RSK, Average_TMK, Average_RSK
  FROM clean c LEFT JOIN day_normals n ON c.station_id = n.station_id AND c.Monat = n.Month AND c.Tag = n.Day
  WHERE Jahr = {YEAR})
"""

_MEANS = ["TMK", "TXK", "TNK"]
_SUMS = ["RSK", "SDK", *DAY_COUNTS]
_METRICS = _MEANS + _SUMS


def _per_year(metrics) -> str:
    return _list(
        f"{_s(f'avg({m})')} AS {m}" if m in _MEANS else f"{_s(f'CAST(coalesce(sum({m}), 0) AS DOUBLE)')} AS {m}"
        for m in metrics
    )


def _mean_over_time(column: str, is_day: bool, month: int | None = None) -> str:
    per_year = _s(f"coalesce(sum({column}), 0.0)" if is_day else f"avg({column})")
    where = f"Jahr BETWEEN {START} AND {END}" + (f" AND Monat = {month}" if month else "")
    return CLEAN + f"""
SELECT station_id, {_r('avg(v)')} AS Average_column
FROM (SELECT station_id, Jahr, {per_year} AS v FROM clean WHERE {where} GROUP BY 1, 2) GROUP BY 1"""


def _deviation(metrics, month: int | None = None) -> str:
    where = f"WHERE Monat = {month}" if month else ""
    return CLEAN + f""",
per_year AS (SELECT station_id, Jahr, {_per_year(metrics)} FROM clean {where} GROUP BY 1, 2),
normal AS (
  SELECT station_id, {_list(f"{_s(f'avg({m})')} AS {m}" for m in metrics)} FROM per_year
  WHERE Jahr BETWEEN {START} AND {END} GROUP BY 1),
chosen AS (SELECT * FROM per_year WHERE Jahr = {YEAR})
SELECT c.station_id, {_list(
    f"{_r(f'c.{m}')} AS {m}, {_r(f'n.{m}')} AS {m}_normal, {_near(f'c.{m} - n.{m}')} AS {m}_diff" for m in metrics
)}
FROM chosen c LEFT JOIN normal n USING (station_id)"""


_TEMP = ["TMK", "TXK", "TNK", "Sommertag", "Hitzetag", "Frosttag", "Eistag", "Tropennacht"]
_PRECIP = ["RSK", "Regentag", "Schneetag"]
_SUN = ["SDK", "Heiterertag", "Truebertag"]

_periods = [(p, *p.split("-")) for p in ALL_PERIODS]

RUNS = CLEAN + """,
numbered AS (
  SELECT station_id, Jahr, Regentag,
    row_number() OVER (PARTITION BY station_id, Jahr ORDER BY Date)
    - row_number() OVER (PARTITION BY station_id, Jahr, Regentag ORDER BY Date) AS island
  FROM clean),
runs AS (SELECT station_id, Jahr, Regentag, count(*) AS n FROM numbered GROUP BY station_id, Jahr, Regentag, island),
spells AS (
  SELECT station_id, Jahr, CAST(max(n) FILTER (Regentag = 0) AS INT) AS Maximale_Trockenperiode,
    CAST(max(n) FILTER (Regentag = 1) AS INT) AS Maximale_Regenperiode
  FROM runs GROUP BY 1, 2)
"""

DAILY_TABLE = CLEAN + f""",
daily_table AS (
  SELECT station_id, Date AS Datum, TNK AS Tagesttiefsttemperatur, TMK AS Tagesmitteltemperatur,
    TXK AS "Tageshöchsttemperatur", RSK AS Niederschlag, SDK AS Sonnenscheindauer, NM AS Bedeckungsgrad,
    {_near('TXK - TNK')} AS Temperaturspanne
  FROM clean)
"""
_DAILY_COLUMNS = f"""station_id, Datum, {_r('Tagesttiefsttemperatur')} AS Tagesttiefsttemperatur,
  {_r('Tagesmitteltemperatur')} AS Tagesmitteltemperatur, {_r('"Tageshöchsttemperatur"')} AS "Tageshöchsttemperatur",
  {_r('Niederschlag')} AS Niederschlag, {_r('Sonnenscheindauer')} AS Sonnenscheindauer,
  {_r('Bedeckungsgrad')} AS Bedeckungsgrad, Temperaturspanne"""

_AVERAGES = f"""{_near('TNK')} AS Tagesttiefsttemperatur, {_near('TMK')} AS Tagesmitteltemperatur,
  {_near('TXK')} AS "Tageshöchsttemperatur", {_near('RSK')} AS Niederschlag, {_near('SDK')} AS Sonnenscheindauer,
  {_near('NM')} AS Bedeckungsgrad, Sommertage, Hitzetage, Tropennaechte AS "Tropennächte", Frosttage, Eistage,
  Regentage, Schneetage, Heiteretage AS "Heitere Tage", Truebetage AS "Trübe Tage" """

AVERAGED_YEAR = RUNS + _yearly("yearly") + f"""
SELECT station_id, Jahr, {_AVERAGES}, Maximale_Trockenperiode, Maximale_Regenperiode
FROM yearly JOIN spells USING (station_id, Jahr)"""

DAYLENGTH = f"""
WITH points AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS station_id, (s_suppkey * 37 % 1701 - 850) / 10 AS lat FROM supplier),
series AS (
  SELECT station_id, lat, CAST(make_date({YEAR}, 1, 1) + CAST(i AS INT) AS DATE) AS date
  FROM points, range(366) r(i)),
angle AS (
  SELECT *, -tan(radians(lat)) * tan(radians(23.5 * sin(radians(CAST(360 AS DOUBLE) / 365 * (dayofyear(date) - 81))))) AS x
  FROM series),
lengths AS (
  SELECT station_id, date, CAST(month(date) AS INT) AS Monat,
    {_near("CASE WHEN x < -1 THEN 24.0::DOUBLE WHEN x > 1 THEN 0.0::DOUBLE ELSE 2 * degrees(acos(x)) / 15 END", 2)} AS sunshine_duration
  FROM angle)
"""

STATIONS = """
stations AS (
  SELECT printf('Station %04d', CAST(s_suppkey // 8 + 1 AS INT)) AS name, printf('%04d', CAST(s_suppkey // 8 + 1 AS INT)) AS number,
    CAST(s_suppkey // 8 % 900 AS DOUBLE) AS height, 6.0::DOUBLE + min(s_nationkey) % 9 AS lon,
    47.0::DOUBLE + (s_suppkey // 8 % 80)::DOUBLE / 10 AS lat
  FROM supplier GROUP BY s_suppkey // 8)
"""

LIVE = """
WITH obs AS (
  SELECT printf('%04d', user_id) AS station_id, CAST(floor(epoch(ts)) AS BIGINT) AS dt,
    strftime(timezone('Europe/Berlin', to_timestamp(floor(epoch(ts)))), '%d. ')
      || ['Jan', 'Feb', 'Mär', 'Apr', 'Mai', 'Jun', 'Jul', 'Aug', 'Sep', 'Okt', 'Nov', 'Dez'][
        CAST(month(timezone('Europe/Berlin', to_timestamp(floor(epoch(ts))))) AS INT)]
      || strftime(timezone('Europe/Berlin', to_timestamp(floor(epoch(ts)))), '. %Y %H:%M') AS local_time,
    event_type AS description, (event_id % 400)::DOUBLE / 10 + 253.15::DOUBLE - 273.15::DOUBLE AS temp,
    950 + event_id % 101 AS pressure, event_id % 101 AS humidity, (event_id % 200)::DOUBLE / 10 * 3.6::DOUBLE AS wind_kmh,
    event_id * 37 % 361 AS wind_deg, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE (event_id % 50)::DOUBLE / 10 END AS rain
  FROM events)
"""
_LIVE_COLUMNS = f"""station_id, dt, local_time, description, {_r('temp')} AS temp, pressure, humidity,
  {_r('wind_kmh')} AS wind_kmh, wind_deg, {_r('rain')} AS rain"""
LIVE_LATEST = LIVE + f"""
SELECT {_LIVE_COLUMNS} FROM (
  SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY dt DESC, local_time DESC, description DESC, temp DESC,
    pressure DESC, humidity DESC, wind_kmh DESC, wind_deg DESC, rain DESC) AS n FROM obs) WHERE n = 1"""


def _band(column: str) -> str:
    low, high = BAND_RANGES[column]
    width = (high - low) / 3
    return (
        f"CASE WHEN {column} < {low} OR {column} > {high} THEN NULL "
        f"WHEN {column} < {low}::DOUBLE + {width!r}::DOUBLE THEN 1 "
        f"WHEN {column} < {low}::DOUBLE + 2 * {width!r}::DOUBLE THEN 2 "
        f"WHEN {column} IS NOT NULL THEN 3 END AS {column}_band"
    )


_CLASS = "CASE WHEN RSK IS NULL THEN NULL " + " ".join(
    f"WHEN RSK >= {b} THEN {b}::DOUBLE" for b in reversed(PRECIP_BREAKS)
) + " END"

_LAYER_ROWS = _list(f"({i}, '{l}', '{a}', '{u}', {str(c).lower()})" for i, (l, a, u, c) in enumerate(MAP_LAYERS))

_SQUARES = "WITH sq AS (SELECT (c_custkey % 1000)::DOUBLE AS x, (c_custkey // 1000)::DOUBLE AS y FROM customer)"

ORACLE: dict[str, str] = {
    "src_dwd_csv": RAW + f"SELECT station_id, MESS_DATUM, {_MEASURES_6} FROM raw",
    "src_station_counts": CLEAN + """
SELECT station_id, coalesce(n_rows, 0) AS n_rows, n_file_rows
FROM (SELECT station_id, count(*) AS n_file_rows FROM raw GROUP BY 1)
  LEFT JOIN (SELECT station_id, count(*) AS n_rows FROM clean GROUP BY 1) USING (station_id)""",
    "src_loaded_total": CLEAN + "SELECT count(DISTINCT station_id) AS n_stations, count(*) AS n_rows FROM clean",
    "src_station_id": RAW + "SELECT station_id, CAST(station_id AS INT) AS STATIONS_ID, count(*) AS n_rows FROM raw GROUP BY 1, 2",
    "src_stations_geojson": f"""
SELECT c_name AS name, printf('%04d', c_custkey) AS number, CAST(c_custkey % 2962 AS DOUBLE) AS height,
  {_r('(c_custkey % 3600) / 10 - 180')} AS lon, {_r('(c_custkey % 1701) / 10 - 85')} AS lat
FROM customer""",
    "src_stations_large_geojson": f"""
SELECT c_name AS name, printf('%04d', c_custkey) AS number, CAST(c_custkey % 2962 AS DOUBLE) AS height,
  {_r('(c_custkey % 3600) / 10 - 180')} AS lon, {_r('(c_custkey % 1701) / 10 - 85')} AS lat
FROM customer""",
    "snk_roundtrip": AVERAGED_YEAR,
    "set_union_stations": RAW + f"SELECT station_id, Date, {_MEASURES_6} FROM days",
    "prj_date_parts": RAW + """
SELECT station_id, MESS_DATUM, Date, Jahr, Monat, Tag, Date AS Day, make_date(2000, Monat, Tag) AS Date_without_year
FROM days""",
    "prj_month_label": RAW + f"""
SELECT station_id, Monat, count(*) AS n_rows, {_LABELS}[Monat] AS Monat_german FROM days GROUP BY station_id, Monat""",
    "prj_threshold_days": CLEAN + f"SELECT station_id, Date, {_list(DAY_COUNTS)} FROM clean",
    "cln_complete_years": VALID + "SELECT station_id, Jahr, count(*) AS n_rows FROM valid GROUP BY 1, 2",
    "cln_missing_counts": VALID + f"""
SELECT station_id, Jahr, {_list(f"count(*) FILTER ({c} = -999) AS {c}_missing" for c in MEASURES)}
FROM valid GROUP BY 1, 2""",
    "cln_dayofyear_mean": VALID + f"""
SELECT station_id, Monat, Tag, {_list(f"{_r(f'avg({c}) FILTER ({c} <> -999)')} AS {c}_mean" for c in MEASURES)}
FROM valid GROUP BY 1, 2, 3""",
    "src_rejected_rows": RAW + """
SELECT station_id, CASE WHEN MESS_DATUM % 10000 = 903 THEN 'impossible_day' ELSE 'malformed' END AS reason, count(*) AS n_rows
FROM raw WHERE MESS_DATUM % 10000 IN (513, 721, 903) GROUP BY 1, 2""",
    "src_landed_rows": RAW + f"SELECT station_id, MESS_DATUM, {_MEASURES_6} FROM raw WHERE MESS_DATUM % 10000 NOT IN (513, 721, 903)",
    "src_versioned_store": CLEAN + f"SELECT station_id, Date, {_MEASURES_6} FROM filled",
    "cln_gapfill": CLEAN + f"SELECT station_id, Date, {_MEASURES_6} FROM filled",
    "flt_year": CLEAN + f"SELECT station_id, Date, {_MEASURES_6} FROM clean WHERE Jahr = {YEAR}",
    "flt_month": CLEAN + f"SELECT station_id, Date, {_MEASURES_6} FROM clean WHERE Jahr = {YEAR} AND Monat = {MONTH}",
    "flt_zero_temp": YEARLY_MONTH + f"""
SELECT station_id, Jahr, {_r('TNK')} AS TNK, {_r('TMK')} AS TMK, {_r('TXK')} AS TXK
FROM yearly WHERE TMK <> 0 AND TXK <> 0 AND TNK <> 0""",
    "flt_station": f"WITH {STATIONS} SELECT * FROM stations WHERE name = 'Station 0001' AND number = '0001'",
    "jn_station": CLEAN + f""", {STATIONS}
SELECT station_id, Date, {_r('TMK')} AS TMK, name, height, {_r('lon')} AS lon, {_r('lat')} AS lat
FROM clean JOIN stations ON station_id = number""",
    "jn_station_semi": CLEAN + f""", {STATIONS}
SELECT name, number, height, {_r('lon')} AS lon, {_r('lat')} AS lat
FROM stations WHERE number IN (SELECT station_id FROM clean)""",
    "agg_bounds": CLEAN + f"""
SELECT station_id, min(Jahr) AS first_year, max(Jahr) AS last_year, {_r('max(RSK)')} AS max_RSK,
  {_r('min(RSK) FILTER (RSK > 0)')} AS min_positive_RSK
FROM clean GROUP BY 1""",
    "agg_distinct_months": CLEAN + "SELECT DISTINCT station_id, Monat, Monat_german FROM clean",
    "agg_yearly": YEARLY + f"SELECT {_YEARLY_COLUMNS} FROM yearly",
    "agg_yearly_month": YEARLY_MONTH + f"SELECT {_YEARLY_COLUMNS} FROM yearly",
    "srt_yearly": YEARLY + f"""
SELECT station_id, Jahr, {_r('TMK')} AS TMK, {_r('RSK')} AS RSK FROM yearly ORDER BY Jahr NULLS LAST, station_id""",
    "nrm_mean_over_time": _mean_over_time("TMK", False),
    "nrm_mean_over_time_month": _mean_over_time("TXK", False, MONTH),
    "nrm_sum_over_time": _mean_over_time("SDK", True),
    "nrm_sum_over_time_month": _mean_over_time("RSK", True, MONTH),
    "nrm_all_metrics": CLEAN + f"""
SELECT station_id, {_list(f"{_r(f'avg({m})')} AS {m}" for m in _METRICS)}
FROM (SELECT station_id, Jahr, {_per_year(_METRICS)} FROM clean WHERE Jahr BETWEEN {START} AND {END} GROUP BY 1, 2)
GROUP BY 1""",
    "nrm_all_periods": CLEAN + f""",
periods(Period, first_year, last_year) AS (VALUES {_list(f"('{p}', {s}, {e})" for p, s, e in _periods)})
SELECT station_id, Period, {_list(f"{_r(f'avg({m})')} AS {m}" for m in _METRICS)}
FROM (
  SELECT station_id, Period, Jahr, {_per_year(_METRICS)}
  FROM clean JOIN periods ON Jahr BETWEEN first_year AND last_year GROUP BY 1, 2, 3)
GROUP BY 1, 2""",
    "nrm_period_table": CLEAN + f""",
periods AS (
  SELECT printf('P%06d', CAST(s_suppkey AS INT)) AS Period, 1985 + s_suppkey % 17 AS first_year, 1985 + s_suppkey % 17 + s_suppkey % 7 AS last_year
  FROM supplier),
per_year AS (SELECT station_id, Jahr, {_per_year(_METRICS)} FROM clean GROUP BY 1, 2)
SELECT station_id, Period, {_list(f"{_r(f'avg({m})')} AS {m}" for m in _METRICS)}
FROM per_year JOIN periods ON Jahr BETWEEN first_year AND last_year GROUP BY 1, 2""",
    "nrm_daily": DAY_NORMALS + f"""
SELECT station_id, Month, Day, {_r('Average_TMK')} AS Average_TMK, {_r('Average_RSK')} AS Average_RSK,
  {_r('Average_SDK')} AS Average_SDK
FROM day_normals""",
    "nrm_join_year": YEAR_NORMALS + f"""
SELECT station_id, Date, {_r('TMK')} AS TMK, {_r('RSK')} AS RSK, {_r('Average_TMK')} AS Average_TMK,
  {_r('Average_RSK')} AS Average_RSK
FROM joined""",
    "nrm_join_month": YEAR_NORMALS + f"""
SELECT station_id, Date, {_r('TMK')} AS TMK, {_r('RSK')} AS RSK, {_r('Average_TMK')} AS Average_TMK,
  {_r('Average_RSK')} AS Average_RSK
FROM joined WHERE month(Date) = {LEAP_MONTH}""",
    "dev_temp_year": _deviation(_TEMP),
    "dev_temp_month": _deviation(_TEMP, MONTH),
    "dev_precip_year": _deviation(_PRECIP),
    "dev_precip_month": _deviation(_PRECIP, MONTH),
    "dev_sun_year": _deviation(_SUN),
    "dev_sun_month": _deviation(_SUN, MONTH),
    "dev_all_year": _deviation(_TEMP + _PRECIP + _SUN),
    "tile_temp": CLEAN + f"""
SELECT station_id, {_r('avg(TNK)')} AS TNK_avg, {_r('avg(TMK)')} AS TMK_avg, {_r('avg(TXK)')} AS TXK_avg,
  count(*) FILTER (TXK >= 25) AS Sommertage, count(*) FILTER (TXK >= 30) AS Hitzetage,
  count(*) FILTER (TNK >= 20) AS Tropennaechte, count(*) FILTER (TNK < 0) AS Frosttage,
  count(*) FILTER (TXK < 0) AS Eistage
FROM clean WHERE Jahr = {YEAR} GROUP BY 1""",
    "tile_temp_month": CLEAN + f"""
SELECT station_id, {_r('avg(TNK)')} AS TNK_avg, {_r('avg(TMK)')} AS TMK_avg, {_r('avg(TXK)')} AS TXK_avg,
  count(*) FILTER (TXK >= 25) AS Sommertage, count(*) FILTER (TXK >= 30) AS Hitzetage,
  count(*) FILTER (TNK >= 20) AS Tropennaechte, count(*) FILTER (TNK < 0) AS Frosttage,
  count(*) FILTER (TXK < 0) AS Eistage
FROM clean WHERE Jahr = {YEAR} AND Monat = {MONTH} GROUP BY 1""",
    "tile_precip": CLEAN + f"""
SELECT station_id, {_r('coalesce(sum(RSK), 0.0)')} AS RSK_sum, count(*) FILTER (RSK >= 0.1) AS Regentage,
  count(*) FILTER (SHK_TAG > 1) AS Schneetage
FROM clean WHERE Jahr = {YEAR} GROUP BY 1""",
    "tile_precip_month": CLEAN + f"""
SELECT station_id, {_r('coalesce(sum(RSK), 0.0)')} AS RSK_sum, count(*) FILTER (RSK >= 0.1) AS Regentage,
  count(*) FILTER (SHK_TAG > 1) AS Schneetage
FROM clean WHERE Jahr = {YEAR} AND Monat = {MONTH} GROUP BY 1""",
    "tile_sun": CLEAN + f"""
SELECT station_id, {_r('coalesce(sum(SDK), 0.0)')} AS SDK_sum, count(*) FILTER (NM < 1.6) AS Heiteretage,
  count(*) FILTER (NM > 6.4) AS Truebetage
FROM clean WHERE Jahr = {YEAR} GROUP BY 1""",
    "tile_sun_month": CLEAN + f"""
SELECT station_id, {_r('coalesce(sum(SDK), 0.0)')} AS SDK_sum, count(*) FILTER (NM < 1.6) AS Heiteretage,
  count(*) FILTER (NM > 6.4) AS Truebetage
FROM clean WHERE Jahr = {YEAR} AND Monat = {MONTH} GROUP BY 1""",
    "tile_temp_all": YEARLY + f"""
SELECT station_id, {_r('avg(TNK)')} AS TNK_avg, {_r('avg(TMK)')} AS TMK_avg, {_r('avg(TXK)')} AS TXK_avg,
  {_list(f"{_near(_s(f'avg({c})'))} AS {c}" for c in ("Sommertage", "Hitzetage", "Tropennaechte", "Frosttage", "Eistage"))}
FROM yearly GROUP BY 1""",
    "tile_precip_all": YEARLY + f"""
SELECT station_id, min(Jahr) AS first_year, max(Jahr) AS last_year, {_r('avg(RSK)')} AS Avg_RSK_sum,
  {_r('avg(Regentage)')} AS Avg_Regentage, {_r('avg(Schneetage)')} AS Avg_Schneetage
FROM yearly WHERE RSK <> 0 GROUP BY 1""",
    "tile_sun_all": YEARLY + f"""
SELECT station_id, min(Jahr) AS first_year, max(Jahr) AS last_year, {_r('avg(SDK)')} AS Avg_SDK_sum,
  {_r('avg(Heiteretage)')} AS Avg_Heiteretage, {_r('avg(Truebetage)')} AS Avg_Truebetage
FROM yearly WHERE SDK <> 0 GROUP BY 1""",
    "win_cumsum_precip": YEAR_NORMALS + f"""
SELECT station_id, Date, {_r('RSK')} AS RSK,
  CASE WHEN count(*) OVER w = count(RSK) OVER w THEN {_r('sum(RSK) OVER w')} END AS Cumulative_RSK
FROM joined WINDOW w AS (PARTITION BY station_id ORDER BY Date ROWS UNBOUNDED PRECEDING)""",
    "win_cumsum_normal": YEAR_NORMALS + f"""
SELECT station_id, Date, {_r('Average_RSK')} AS Average_RSK,
  CASE WHEN count(*) OVER w = count(Average_RSK) OVER w THEN {_r('sum(Average_RSK) OVER w')} END AS Cumulative_avg_RSK
FROM joined WINDOW w AS (PARTITION BY station_id ORDER BY Date ROWS UNBOUNDED PRECEDING)""",
    "win_cumsum_normal_skip": YEAR_NORMALS + f"""
SELECT station_id, Date, {_r('Average_RSK')} AS Average_RSK, {_r('sum(Average_RSK) OVER w')} AS Cumulative_avg_RSK
FROM joined WINDOW w AS (PARTITION BY station_id ORDER BY Date ROWS UNBOUNDED PRECEDING)""",
    "win_cumsum_sun": CLEAN + f"""
SELECT station_id, Date, {_r('SDK')} AS SDK, {_r('sum(SDK) OVER w')} AS Cumulative_SDK
FROM clean WHERE SDK IS NOT NULL WINDOW w AS (PARTITION BY station_id, Jahr ORDER BY Date ROWS UNBOUNDED PRECEDING)""",
    "win_cumsum_yearly": YEARLY + f"""
SELECT station_id, Jahr, {_r('RSK')} AS RSK, {_r('sum(RSK) OVER w')} AS Cumulative_RSK
FROM yearly WHERE RSK <> 0 WINDOW w AS (PARTITION BY station_id ORDER BY Jahr ROWS UNBOUNDED PRECEDING)""",
    "win_cumsum_yearly_sun": YEARLY + f"""
SELECT station_id, Jahr, {_r('SDK')} AS SDK, {_r('sum(SDK) OVER w')} AS Cumulative_SDK
FROM yearly WHERE SDK > 0 WINDOW w AS (PARTITION BY station_id ORDER BY Jahr ROWS UNBOUNDED PRECEDING)""",
    "win_spells": RUNS + "SELECT * FROM spells",
    "win_warm_cold": YEAR_NORMALS + """,
classed AS (
  SELECT *, CASE WHEN TMK > Average_TMK THEN 'Zu warm' WHEN TMK < Average_TMK THEN 'Zu kalt' END AS Abweichung
  FROM joined),
islands AS (
  SELECT *, row_number() OVER (PARTITION BY station_id, Jahr ORDER BY Date)
    - row_number() OVER (PARTITION BY station_id, Jahr, Abweichung ORDER BY Date) AS island
  FROM classed)
SELECT station_id, Jahr, Abweichung, min(Date) AS first_day, max(Date) AS last_day, count(*) AS n_days
FROM islands WHERE Abweichung IS NOT NULL GROUP BY station_id, Jahr, Abweichung, island""",
    "tbl_daily": DAILY_TABLE + f"SELECT {_DAILY_COLUMNS} FROM daily_table",
    "tbl_averaged_year": AVERAGED_YEAR,
    "tbl_averaged_month": YEARLY_MONTH + f"""
SELECT station_id, '{MONTHS[MONTH - 1]} ' || CAST(Jahr AS VARCHAR) AS Monat_Jahr, {_AVERAGES} FROM yearly""",
    "tbl_search_builder": DAILY_TABLE + f"""
SELECT {_DAILY_COLUMNS} FROM daily_table
WHERE "Tageshöchsttemperatur" > 30.0
  OR (Niederschlag BETWEEN 20.0 AND 25.0 AND Sonnenscheindauer IS NOT NULL AND month(Datum) = 7)""",
    "tbl_text_search": DAILY_TABLE + f"""
SELECT {_DAILY_COLUMNS} FROM daily_table d
WHERE CAST(Datum AS VARCHAR) LIKE '%-07-1%' AND concat_ws('  ', station_id, Datum, Tagesttiefsttemperatur,
  Tagesmitteltemperatur, "Tageshöchsttemperatur", Niederschlag, Sonnenscheindauer, Bedeckungsgrad, Temperaturspanne)
  LIKE '%0.0%'""",
    "tbl_top_k": DAILY_TABLE + f"""
SELECT station_id, CAST(Rang AS INT) AS Rang, Datum, {_r('"Tageshöchsttemperatur"')} AS "Tageshöchsttemperatur"
FROM (SELECT *, row_number() OVER (
  PARTITION BY station_id ORDER BY "Tageshöchsttemperatur" DESC NULLS LAST, Datum) AS Rang FROM daily_table)
WHERE Rang <= 10""",
    "rsh_temp_long": CLEAN + f"""
SELECT station_id, Day, Cat, {_r('value')} AS value, CAST(Cat_order AS INT) AS Cat_order FROM (
  SELECT station_id, Day, 'TNK' AS Cat, TNK AS value, 1 AS Cat_order FROM clean WHERE Jahr = {YEAR}
  UNION ALL SELECT station_id, Day, 'TMK', TMK, 2 FROM clean WHERE Jahr = {YEAR}
  UNION ALL SELECT station_id, Day, 'TXK', TXK, 3 FROM clean WHERE Jahr = {YEAR})""",
    "rsh_temp_long_yearly": YEARLY + f"""
SELECT station_id, Jahr, Day, Cat, {_r('value')} AS value, CAST(Cat_order AS INT) AS Cat_order FROM (
  SELECT station_id, Jahr, Day, 'TNK' AS Cat, TNK AS value, 1 AS Cat_order FROM yearly
  UNION ALL SELECT station_id, Jahr, Day, 'TMK', TMK, 2 FROM yearly
  UNION ALL SELECT station_id, Jahr, Day, 'TXK', TXK, 3 FROM yearly)
WHERE value <> 0""",
    "sun_daylength": DAYLENGTH + "SELECT station_id, date, sunshine_duration, Monat FROM lengths",
    "sun_month": DAYLENGTH + f"""
SELECT station_id, date, sunshine_duration, '{MONTHS[MONTH - 1]}' AS Monat_german FROM lengths WHERE Monat = {MONTH}""",
    "sun_overlay": CLEAN + f""", {STATIONS},
located AS (SELECT DISTINCT station_id, lat
  FROM clean LEFT JOIN (SELECT * FROM stations WHERE CAST(number AS BIGINT) % 4 <> 1) ON station_id = number
  WHERE Jahr = {YEAR} AND SDK IS NOT NULL),
angle AS (
  SELECT station_id, date, -tan(radians(lat))
    * tan(radians(23.5 * sin(radians(CAST(360 AS DOUBLE) / 365 * (dayofyear(date) - 81))))) AS x
  FROM (SELECT station_id, lat, CAST(make_date({YEAR}, 1, 1) + CAST(i AS INT) AS DATE) AS date FROM located, range(366) r(i)))
SELECT a.station_id, a.date,
  {_near("CASE WHEN x < -1 THEN 24.0::DOUBLE WHEN x > 1 THEN 0.0::DOUBLE WHEN x IS NOT NULL THEN 2 * degrees(acos(x)) / 15 END", 2)} AS sunshine_duration,
  {_r('SDK')} AS SDK
FROM angle a LEFT JOIN clean c ON a.station_id = c.station_id AND a.date = c.Date""",
    "fn_precip_classes": CLEAN + f"""
SELECT station_id, Jahr, {_CLASS} AS class_from, count(*) AS n_days,
  {_r('avg(CASE WHEN RSK = 0 THEN 0.0 ELSE ln(1 + RSK) END)')} AS mean_scaled
FROM clean GROUP BY 1, 2, 3""",
    "fn_precip_record_scale": YEARLY + f"""
SELECT station_id, Jahr, {_r('RSK')} AS RSK, {_r('ln(RSK)')} AS RSK_scaled FROM yearly WHERE RSK > 0""",
    "geo_bbox": _SQUARES + "SELECT min(x) AS xmin, min(y) AS ymin, max(x + 1) AS xmax, max(y + 1) AS ymax FROM sq",
    "geo_boundary_edges": _SQUARES + """
SELECT DISTINCT * FROM (
  SELECT x AS x1, y AS y1, x + 1 AS x2, y AS y2 FROM sq
  UNION ALL SELECT x + 1, y, x + 1, y + 1 FROM sq
  UNION ALL SELECT x, y + 1, x + 1, y + 1 FROM sq
  UNION ALL SELECT x, y, x, y + 1 FROM sq)""",
    "map_layer_value": f"""
WITH layers(i, layer, alias, unit, conv) AS (VALUES {_LAYER_ROWS}),
readings AS (SELECT event_id % 8 AS i, CAST(event_id * 13 % 1000 AS DOUBLE) AS raw FROM events)
SELECT layer, raw, CASE WHEN conv THEN raw / 10 ELSE raw END AS value,
  printf('%s: %.1f %s', alias, CASE WHEN conv THEN raw / 10 ELSE raw END, unit) AS label
FROM readings JOIN layers USING (i)""",
    "live_normalise": LIVE + f"SELECT {_LIVE_COLUMNS} FROM obs",
    "live_normalise_stream": LIVE + f"SELECT {_LIVE_COLUMNS} FROM obs",
    "live_latest": LIVE_LATEST,
    "live_latest_stream": LIVE_LATEST,
    "live_wind_rose": LIVE + f"""
SELECT station_id, [{_list(f"'{c}'" for c in COMPASS)}][CAST(round_even(wind_deg::DOUBLE / 22.5, 0) AS INT) + 1] AS sector,
  count(*) AS n_observations, {_r('avg(wind_kmh)')} AS mean_wind_kmh
FROM obs GROUP BY 1, 2""",
    "live_bands": LIVE + f"""
SELECT station_id, dt, {_r('temp')} AS temp, pressure, humidity, {_list(_band(c) for c in BAND_RANGES)} FROM obs""",
}

assert PERIODS == ALL_PERIODS[: len(PERIODS)]

# From monthly sums, the rows must be those from daily rows.
ORACLE |= {
    "prt_yearly": ORACLE["agg_yearly"],
    "prt_normals": ORACLE["nrm_all_periods"],
    "prt_period_table": ORACLE["nrm_period_table"].replace("FROM clean GROUP BY 1, 2)", f"FROM clean WHERE Monat = {MONTH} GROUP BY 1, 2)"),
    "prt_deviations": ORACLE["dev_all_year"],
    "prt_temp_month": ORACLE["tile_temp_month"],
    "prt_precip_year": ORACLE["tile_precip"],
    "prt_sun_month": ORACLE["tile_sun_month"],
}
