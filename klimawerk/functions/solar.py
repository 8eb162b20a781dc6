"""Astronomical day length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def declination(day_of_year: Column) -> Column:
    """Solar declination in degrees."""
    return 23.5 * F.sin(F.radians(F.lit(360 / 365) * (day_of_year - 81)))


def day_length(latitude: Column, date: Column) -> Column:
    """Hours between sunrise and sunset, 24 in polar day and 0 in polar night."""
    cos_hour_angle = -F.tan(F.radians(latitude)) * F.tan(F.radians(declination(F.dayofyear(date))))
    return (
        F.when(cos_hour_angle < -1, 24.0)
        .when(cos_hour_angle > 1, 0.0)
        .otherwise(2 * F.degrees(F.acos(cos_hour_angle)) / 15)
    )
