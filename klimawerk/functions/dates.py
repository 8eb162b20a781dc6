"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from klimawerk.schema import MONTHS, MONTHS_SHORT


def parse_day(compact: Column) -> Column:
    """``yyyyMMdd`` as number or text to a date; an impossible day becomes NULL."""
    text = compact.cast("string")
    # The ISO form goes through the plain cast, which is far cheaper per row than a pattern.
    iso = F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))
    return iso.try_cast("date")


def year_free_date(month: Column, day: Column) -> Column:
    """Same month and day in the leap year 2000, so that 29 February always exists."""
    return F.make_date(F.lit(2000), month, day)


def first_of_january(year: Column) -> Column:
    return F.make_date(year, F.lit(1), F.lit(1))


def month_label(month: Column) -> Column:
    """German month name; sort by the month number, never by this label."""
    return F.get(F.array(*[F.lit(m) for m in MONTHS]), month - 1)


def month_number(name: str) -> int:
    return MONTHS.index(name) + 1


def is_leap_day(month: Column, day: Column) -> Column:
    return (month == 2) & (day == 29)


def period_bounds(period: str | tuple[int, int]) -> tuple[int, int]:
    """``"1991-2020"`` or a pair of years to inclusive bounds."""
    if isinstance(period, str):
        start, end = period.split("-")
        return int(start), int(end)
    return period


def in_period(year: Column, period: str | tuple[int, int]) -> Column:
    return year.between(*period_bounds(period))


def local_time_text(epoch_seconds: Column, zone: str = "Europe/Berlin") -> Column:
    """Epoch seconds to local wall-clock text with a German month, independent of the session's time zone and locale."""
    utc = F.timestamp_add("SECOND", epoch_seconds, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    month = F.get(F.array(*[F.lit(m) for m in MONTHS_SHORT]), F.month(local) - 1)
    return F.concat(F.date_format(local, "dd. "), month, F.date_format(local, ". yyyy HH:mm"))
