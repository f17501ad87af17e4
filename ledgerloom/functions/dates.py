"""Dates: strict ISO parsing, ages, weekly periods in a location's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weekday names with Monday as 0, and the default anchor.
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
DEFAULT_RESET = "monday"
DEFAULT_ZONE = "Africa/Johannesburg"
EARLIEST_YEAR, LEAST_AGE, MOST_AGE = 1900, 3, 100

_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"
_COMPACT = r"^\d{8}$"


def iso_date(text: Column) -> Column:
    """The calendar date that an ISO date or date-time names, else null.

    Its own date counts, whatever its offset.  Week dates are not supported.
    """
    t = F.trim(text)
    dashed = F.when(F.rlike(t, F.lit(_ISO)), F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd"))
    return F.coalesce(dashed, F.when(F.rlike(t, F.lit(_COMPACT)), F.try_to_date(t, "yyyyMMdd")))


def birth_date_text(text: Column) -> Column:
    """yyyy-MM-dd, or '' for anything that is no date."""
    return F.coalesce(F.date_format(iso_date(text), "yyyy-MM-dd"), F.lit(""))


def age_years(born: Column, on: Column) -> Column:
    """Calendar age: a year is complete on the birthday itself."""
    before = (F.month(on) < F.month(born)) | ((F.month(on) == F.month(born)) & (F.dayofmonth(on) < F.dayofmonth(born)))
    return F.year(on) - F.year(born) - before.cast("int")


def impossible_date(text: Column, reference: Column, birth: bool = False) -> Column:
    """Present but no date, after the reference, before 1900, or an absurd age."""
    d = iso_date(text)
    bad = d.isNull() | (d > reference) | (F.year(d) < EARLIEST_YEAR)
    if birth:
        age = age_years(d, reference)
        bad = bad | (age < LEAST_AGE) | (age > MOST_AGE)
    blank = F.length(F.trim(F.coalesce(text, F.lit("")))) == 0
    return ~blank & F.coalesce(bad, F.lit(True))


def local_date(utc: Column, zone: str = DEFAULT_ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(utc, zone))


def weekday_index(name: Column) -> Column:
    """0 for Monday to 6; unknown names are the default anchor."""
    n = F.lower(F.trim(name))
    out = F.lit(WEEKDAYS.index(DEFAULT_RESET))
    for k, day in enumerate(WEEKDAYS):
        out = F.when(n == day, F.lit(k)).otherwise(out)
    return out


def period_start(reset: Column, today: Column) -> Column:
    """The latest reset weekday on or before ``today``."""
    return F.date_sub(today, F.pmod(F.weekday(today) - weekday_index(reset), F.lit(7)))
