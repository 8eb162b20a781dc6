"""The two result tables: daily and averaged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klimawerk.functions.dates import month_label
from klimawerk.functions.measures import nearest
from klimawerk.operators.yearly import yearly, yearly_with_spells


def daily_table(clean: DataFrame) -> DataFrame:
    return clean.select(
        "station_id",
        F.col("Day").alias("Datum"),
        F.col("TNK").alias("Tagesttiefsttemperatur"),
        F.col("TMK").alias("Tagesmitteltemperatur"),
        F.col("TXK").alias("Tageshöchsttemperatur"),
        F.col("RSK").alias("Niederschlag"),
        F.col("SDK").alias("Sonnenscheindauer"),
        F.col("NM").alias("Bedeckungsgrad"),
        nearest("TXK - TNK").alias("Temperaturspanne"),
    )


def _averages():
    names = {
        "TNK": "Tagesttiefsttemperatur",
        "TMK": "Tagesmitteltemperatur",
        "TXK": "Tageshöchsttemperatur",
        "RSK": "Niederschlag",
        "SDK": "Sonnenscheindauer",
        "NM": "Bedeckungsgrad",
    }
    return [nearest(c).alias(name) for c, name in names.items()]


def averaged_table(clean: DataFrame, month: int | None = None) -> DataFrame:
    """One row per station and year: 18 columns for the whole year, 16 for one of its months."""
    if month is None:
        return yearly_with_spells(clean).select(
            "station_id",
            F.year("Day").alias("Jahr"),
            *_averages(),
            "Sommertage",
            "Hitzetage",
            F.col("Tropennaechte").alias("Tropennächte"),
            "Frosttage",
            "Eistage",
            F.col("Heiteretage").alias("Heitere Tage"),
            F.col("Truebetage").alias("Trübe Tage"),
            "Regentage",
            "Schneetage",
            "Maximale_Trockenperiode",
            "Maximale_Regenperiode",
        )
    return yearly(clean, month).select(
        "station_id",
        F.concat_ws(" ", month_label(F.lit(month)), F.year("Day")).alias("Monat_Jahr"),
        *_averages(),
        "Sommertage",
        "Hitzetage",
        F.col("Tropennaechte").alias("Tropennächte"),
        "Frosttage",
        "Eistage",
        "Regentage",
        "Schneetage",
        F.col("Heiteretage").alias("Heitere Tage"),
        F.col("Truebetage").alias("Trübe Tage"),
    )
