"""Umm al-Qura dates by the first days of the calendar's months.

The months' first days are one sorted array in the plan, 3,613 numbers. A day's month is looked up in it: the mean length of a
month says where, to one place, and the array which of the neighbours it is. No table of days is made, joined or broadcast.
"""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

YEARS = range(1300, 1601)
MONTHS = 12 * len(YEARS)


@lru_cache(maxsize=1)
def month_starts(spark: SparkSession) -> list[int]:
    """The first day of every month, as days since 1970, and the day after the last, from the JVM's calendar; it must be as it is known to be."""
    of = spark._jvm.java.time.chrono.HijrahDate.of
    starts = [of(y, m, 1).toEpochDay() for y in YEARS for m in range(1, 13)]
    starts.append(starts[-1] + of(YEARS[-1], 12, 1).lengthOfMonth())
    checked(starts)
    return starts


def checked(starts: list[int]) -> None:
    """Refuses month starts that aren't the calendar's: their number, the months' lengths, or a day that is known."""
    lengths = {b - a for a, b in zip(starts, starts[1:])}
    known = {1444: 19203, 1445: 19557, 1446: 19911, 1447: 20265}  # 2022-07-30, 2023-07-19, 2024-07-07, 2025-06-26
    if len(starts) != MONTHS + 1 or lengths != {29, 30} or starts[-1] - starts[0] != 106_665 or any(starts[12 * (y - YEARS[0])] != day for y, day in known.items()):
        raise RuntimeError("the calendar at hand is not Umm al-Qura")
    mean = (starts[-1] - starts[0]) / MONTHS
    if any(abs(int((day - starts[0]) / mean) - k) > 1 for k in range(MONTHS) for day in (starts[k], starts[k + 1] - 1)):
        raise RuntimeError("the calendar's months are too uneven to be looked up by their mean")


def _starts(spark: SparkSession) -> tuple[Column, list[int]]:
    starts = month_starts(spark)
    return F.from_json(F.lit(json.dumps(starts)), "array<int>"), starts  # a constant, which the optimizer folds


def hijri_text(spark: SparkSession, day: Column) -> Column:
    """The year-month-day of a date; null outside the calendar."""
    array, starts = _starts(spark)
    number = F.unix_date(day)
    mean = (starts[-1] - starts[0]) / MONTHS
    guess = F.floor((number - starts[0]) / mean).cast("int")
    at = lambda k: F.get(array, k)
    month = F.when(number < at(guess), guess - 1).when(number >= at(guess + 1), guess + 1).otherwise(guess)
    text = F.format_string("%04d-%02d-%02d", F.floor(month / 12) + YEARS[0], month % 12 + 1, number - at(month) + 1)
    return F.when((number >= starts[0]) & (number < starts[-1]), text)


def gregorian_date(spark: SparkSession, text: Column) -> Column:
    """The date of a year-month-day text; null for one that isn't in the calendar, such as the 30th of a month of 29 days."""
    array, _ = _starts(spark)
    shape = "^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$"
    piece = lambda k: F.nullif(F.regexp_extract(text, shape, k), F.lit("")).try_cast("int")
    year, month, day = piece(1), piece(2), piece(3)
    number = (year - YEARS[0]) * 12 + month - 1
    first = F.get(array, number)
    fits = year.between(YEARS[0], YEARS[-1]) & month.between(1, 12) & (day >= 1) & (day <= F.get(array, number + 1) - first)
    return F.when(fits, F.date_from_unix_date(first + day - 1))


def to_hijri(df: DataFrame, column: str) -> DataFrame:
    """df with hijri; null outside the calendar."""
    return df.withColumn("hijri", hijri_text(df.sparkSession, F.col(column)))


def to_gregorian(df: DataFrame, column: str) -> DataFrame:
    """df with gregorian; null for days that aren't in the calendar."""
    return df.withColumn("gregorian", gregorian_date(df.sparkSession, F.col(column)))


def oracle(spark: SparkSession) -> str:
    """DuckDB SQL for the query of order dates: the same month starts as values, met by an as-of join."""
    values = ", ".join(f"({k}, {s})" for k, s in enumerate(month_starts(spark)))
    return f"""WITH months AS (SELECT * FROM (VALUES {values}) AS t(k, first)),
days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
numbers AS (SELECT day, date_diff('day', DATE '1970-01-01', day) AS n FROM days)
SELECT CAST(day AS VARCHAR) AS day, printf('%04d-%02d-%02d', {YEARS[0]} + k // 12, k % 12 + 1, n - first + 1) AS hijri, CAST(day AS VARCHAR) AS back FROM numbers ASOF JOIN months ON n >= first"""
