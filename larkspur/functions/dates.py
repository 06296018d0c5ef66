"""Date rules as column expressions; every "today" is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The month names of alert texts.
MONTHS = ["يناير", "فبراير", "مارس", "أبريل", "مايو", "يونيو", "يوليو", "أغسطس", "سبتمبر", "أكتوبر", "نوفمبر", "ديسمبر"]


def _rolled(year: Column, month: Column, day: Column) -> Column:
    """The day that many days into the month that many months into the year, past their ends if need be."""
    return F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1), day - 1)


def parse_date(text: Column) -> Column:
    """A date from loose text, else null.

    month/day/year with a slash, where months and days before the first or past the last roll over and two-digit years are of the
    1900s; a year, year-month or year-month-day, also with a UTC time after a T, where days up to 31 roll over and months
    above 12 are no date.
    """
    part = F.split(text, "/")
    number = lambda k: F.get(part, F.lit(k)).try_cast("int")
    year = F.when(number(2).between(0, 99), number(2) + 1900).otherwise(number(2))
    rolling = number(0).between(-9999, 9999) & number(1).between(-99999, 99999)
    slashed = F.when(rolling & year.between(1, 9999), _rolled(year, number(0), number(1)))
    shape = "^([0-9]{4})(?:-([0-9]{1,2})(?:-([0-9]{1,2}))?)?(?:T[0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:[.][0-9]+)?)?Z?)?$"
    found = F.regexp_extract(text, shape, 0) != ""
    piece = lambda k: F.nullif(F.regexp_extract(text, shape, k), F.lit("")).try_cast("int")
    month, day = F.coalesce(piece(2), F.lit(1)), F.coalesce(piece(3), F.lit(1))
    dashed = F.when(found & (piece(1) > 0) & month.between(1, 12) & day.between(1, 31), _rolled(piece(1), month, day))
    return F.when(F.contains(text, F.lit("/")), slashed).otherwise(dashed)


def stage(days: Column) -> Column:
    """The rung of the escalation ladder that the remaining days hit exactly, else null."""
    return F.when(days < 0, "overdue").when(days == 0, "today").when(days == 2, "2day").when(days == 5, "5day")


def is_iso(text: Column) -> Column:
    """Whether text has the shape of a date; its digits may still be none."""
    return F.coalesce(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit(False))


def date_time_text(at: Column) -> Column:
    """Day, month name, hours and minutes; a dash where there is no time."""
    name = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(at))
    return F.when(at.isNull(), "—").otherwise(F.concat_ws(" ", F.dayofmonth(at).cast("string"), name, F.date_format(at, "HH:mm")))


def long_date(day: Column) -> Column:
    """Day, month name and year; a dash where there is no date."""
    name = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day))
    return F.when(day.isNull(), "—").otherwise(F.concat_ws(" ", F.dayofmonth(day).cast("string"), name, F.year(day).cast("string")))
