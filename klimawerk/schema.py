"""Column names, fixed values and file schemas shared by all modules.

The daily table is keyed by ``(station_id, Date)``: one row per station and calendar day; cleaning fails on a second row of
a day. A station-year therefore holds at most 366 rows, a calendar day of a station one row per recorded year and a station
as many rows as its record has days, whatever the size of the table.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values, down to the map layers: they define the results and must not change.
SENTINEL = -999.0
MIN_MONTHS = 11
MAX_MISSING = 60
NORMAL_DIVISOR = 30

MEASURES = ["SDK", "SHK_TAG", "RSK", "TNK", "TMK", "TXK", "FX", "FM", "NM", "VPM", "PM", "UPM", "TGK"]

MONTHS = [
    "Januar", "Februar", "März", "April", "Mai", "Juni",
    "Juli", "August", "September", "Oktober", "November", "Dezember",
]

MONTHS_SHORT = ["Jan", "Feb", "Mär", "Apr", "Mai", "Jun", "Jul", "Aug", "Sep", "Okt", "Nov", "Dez"]

PERIODS = ["1991-2020", "1981-2010", "1971-2000", "1961-1990"]

# flag column, measurement, comparison, threshold
THRESHOLD_DAYS = [
    ("Regentag", "RSK", ">=", 0.1),
    ("Sommertag", "TXK", ">=", 25.0),
    ("Hitzetag", "TXK", ">=", 30.0),
    ("Tropennacht", "TNK", ">=", 20.0),
    ("Frosttag", "TNK", "<", 0.0),
    ("Eistag", "TXK", "<", 0.0),
    ("Schneetag", "SHK_TAG", ">", 1.0),
    ("Heiterertag", "NM", "<", 1.6),
    ("Truebertag", "NM", ">", 6.4),
]

# flag column -> name of its yearly count
DAY_COUNTS = {
    "Regentag": "Regentage",
    "Sommertag": "Sommertage",
    "Hitzetag": "Hitzetage",
    "Tropennacht": "Tropennaechte",
    "Frosttag": "Frosttage",
    "Eistag": "Eistage",
    "Schneetag": "Schneetage",
    "Heiterertag": "Heiteretage",
    "Truebertag": "Truebetage",
}

PRECIP_BREAKS = [0.0, 0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0]

COMPASS = [
    "N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE",
    "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW", "N",
]

# live value -> range of its three equal bands
BAND_RANGES = {"temp": (-20.0, 40.0), "pressure": (950.0, 1050.0), "humidity": (0.0, 100.0)}

DEFAULT_STATION = "0403"
DEFAULT_LAT = 52.4537

# layer, alias, unit, raw value is in tenths
MAP_LAYERS = [
    ("dwd:TAMM_17_1961_30", "Durchschnittstemperatur (1961-1990)", "°C", True),
    ("dwd:TADXMM_17_1961_30", "Maximaltemperatur (1961-1990)", "°C", True),
    ("dwd:TADNMM_17_1961_30", "Minimaltemperatur (1961-1990)", "°C", True),
    ("dwd:Summerdays_annual_map_normals_1971_30", "Sommertage pro Jahr (1971-2000)", "Tage", False),
    ("dwd:Frostdays_annual_map_normals_1971_30", "Frosttage pro Jahr (1971-2000)", "Tage", False),
    ("dwd:RSMS_17_1961_30", "Niederschlag pro Jahr (1961-1990)", "mm", False),
    ("dwd:Snowdays_annual_map_normals_1971_30", "Schneetage pro Jahr (1971-2000)", "Tage", False),
    ("dwd:SDMS_17_1961_30", "Sonnenscheindauer pro Jahr (1961-1990)", "Stunden", False),
]

# Daily rows before cleaning (the columns every source has) and after it.
RAW_DAYS = "station_id string, MESS_DATUM int, " + ", ".join(f"{m} double" for m in MEASURES)
CLEAN_DAYS = (
    RAW_DAYS
    + ", Date date, Jahr int, Monat int, Tag int, Day date, Date_without_year date, Monat_german string, "
    + ", ".join(f"{name} int" for name, *_ in THRESHOLD_DAYS)
)

# Public column layout of a daily station file.
STATION_FILE = T.StructType([
    T.StructField("STATIONS_ID", T.IntegerType()),
    T.StructField("MESS_DATUM", T.IntegerType()),
    T.StructField("QN_3", T.IntegerType()),
    T.StructField("FX", T.DoubleType()),
    T.StructField("FM", T.DoubleType()),
    T.StructField("QN_4", T.IntegerType()),
    T.StructField("RSK", T.DoubleType()),
    T.StructField("RSKF", T.IntegerType()),
    T.StructField("SDK", T.DoubleType()),
    T.StructField("SHK_TAG", T.DoubleType()),
    T.StructField("NM", T.DoubleType()),
    T.StructField("VPM", T.DoubleType()),
    T.StructField("PM", T.DoubleType()),
    T.StructField("TMK", T.DoubleType()),
    T.StructField("UPM", T.DoubleType()),
    T.StructField("TXK", T.DoubleType()),
    T.StructField("TNK", T.DoubleType()),
    T.StructField("TGK", T.DoubleType()),
    T.StructField("eor", T.StringType()),
])

# Public layout of one landed live observation; ``rain`` holds the amount of the last hour.
LIVE_PAYLOAD = T.StructType([
    T.StructField("list", T.ArrayType(T.StructType([
        T.StructField("dt", T.LongType()),
        T.StructField("main", T.StructType([
            T.StructField("temp", T.DoubleType()),
            T.StructField("pressure", T.LongType()),
            T.StructField("humidity", T.LongType()),
        ])),
        T.StructField("wind", T.StructType([
            T.StructField("speed", T.DoubleType()),
            T.StructField("deg", T.LongType()),
        ])),
        T.StructField("weather", T.ArrayType(T.StructType([
            T.StructField("description", T.StringType()),
        ]))),
        T.StructField("rain", T.StructType([T.StructField("1h", T.DoubleType())])),
    ]))),
])
