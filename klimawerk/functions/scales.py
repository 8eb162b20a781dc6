"""Classes and scales: compass sectors, thirds of a range, precipitation intensity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from klimawerk.schema import COMPASS, PRECIP_BREAKS


def compass_sector(degrees: Column) -> Column:
    """Sixteen-point compass name; ties go to the even sector, values outside the circle give NULL."""
    return F.get(F.array(*[F.lit(c) for c in COMPASS]), F.bround(degrees / 22.5).cast("int"))


def band(value: Column, low: float, high: float) -> Column:
    """Third of ``[low, high]`` that holds the value (1, 2, 3); NULL outside the range."""
    third = (high - low) / 3
    return (
        F.when((value < low) | (value > high), None)
        .when(value < low + third, 1)
        .when(value < low + 2 * third, 2)
        .when(value.isNotNull(), 3)
    )


def precip_scale(amount: Column) -> Column:
    """Compressing scale for daily precipitation."""
    return F.when(amount == 0, 0.0).otherwise(F.log1p(amount))


def precip_unscale(scaled: Column) -> Column:
    return F.expm1(scaled)


def precip_class(amount: Column) -> Column:
    """Lower break of the intensity class that holds the amount; NULL for a missing amount."""
    result = F.when(amount.isNull(), None)
    for lower in reversed(PRECIP_BREAKS):
        result = result.when(amount >= lower, lower)
    return result
