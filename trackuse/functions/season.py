"""Timestamps and the migratory-cycle calendar, as column expressions.

Times are UTC wall clock in ``timestamp_ntz``, so no result depends on the
session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DAY = r"\d{4}-\d{1,2}-\d{1,2}"
_CLOCK = r"\d{1,2}:\d{1,2}:\d{1,2}(\.\d+)?"
_UTC = rf"^\s*{_DAY}([ T]{_CLOCK}Z?)?\s*$"
_OFFSET = rf"^\s*{_DAY}[ T]{_CLOCK}[+-]\d{{2}}:\d{{2}}\s*$"


def parse_timestamp(c: Column | str) -> Column:
    """Text to UTC time: date-time first, else date only, else null.

    Midnight is written without a clock, hence the date-only form. The anchored
    patterns keep Spark's looser cast from accepting a bare year or month.
    """
    c = F.col(c) if isinstance(c, str) else c
    shifted = F.convert_timezone(None, F.lit("UTC"), c.try_cast("timestamp").cast("timestamp_ntz"))
    return F.when(c.rlike(_UTC), c.try_cast("timestamp_ntz")).when(c.rlike(_OFFSET), shifted)


def as_utc(df: DataFrame, name: str) -> Column:
    """Column ``name`` as UTC time, parsing only when it is text.

    A column already stored as ``timestamp_ntz`` passes through untouched, so
    range filters on it still reach the Parquet scan.
    """
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.col(name)
    if isinstance(kind, T.TimestampType):
        return F.convert_timezone(None, F.lit("UTC"), F.col(name).cast("timestamp_ntz"))
    if isinstance(kind, T.DateType):
        return F.col(name).cast("timestamp_ntz")
    return parse_timestamp(name)


def parse_date(c: Column | str, strict: bool = True) -> Column:
    """Text to date. Strict: text with a time of day gives null."""
    c = F.col(c) if isinstance(c, str) else c
    if strict:
        return F.when(c.rlike(rf"^\s*{_DAY}\s*$"), c.try_cast("date"))
    return parse_timestamp(c).cast("date")


def as_date(df: DataFrame, name: str, strict: bool = True) -> Column:
    """Column ``name`` as a date, parsing only when it is text.

    Strict: a time of day gives null. A typed midnight is a date, as the text
    written from it would be.
    """
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return F.col(name)
    if not isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return parse_date(name, strict)
    time = as_utc(df, name)
    day = time.cast("date")
    return F.when(time == day.cast("timestamp_ntz"), day) if strict else day


def cycle_year(date: Column | str, month: int = 6, day: int = 1) -> Column:
    """Calendar year in which the cycle holding ``date`` began."""
    before = (F.month(date) < month) | ((F.month(date) == month) & (F.dayofmonth(date) < day))
    return F.year(date) - before.cast("int")


def with_cycle(df: DataFrame, date: str = "date", month: int = 6, day: int = 1) -> DataFrame:
    """Add ``nb_year``, ``nb_year_start`` and the 1-based ``day_in_year``."""
    return (
        df.withColumn("nb_year", cycle_year(date, month, day))
        .withColumn("nb_year_start", F.make_date("nb_year", F.lit(month), F.lit(day)))
        .withColumn("day_in_year", F.datediff(date, "nb_year_start") + 1)
    )


def wrap_day(c: Column, n: int = 366) -> Column:
    """Day index folded into 1..n, with a floor modulo."""
    return F.pmod(c - 1, F.lit(n)) + 1


def cycle_day_label(c: Column, month: int = 6, day: int = 1) -> Column:
    """Day index as ``Jun 01`` text, counted from the anchor in non-leap 2001."""
    start = F.make_date(F.lit(2001), F.lit(month), F.lit(day))
    return F.date_format(F.date_add(start, (c - 1).cast("int")), "MMM dd")
