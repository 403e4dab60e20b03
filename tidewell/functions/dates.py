"""Dates kept as text, whole-year ages, durations and how they are written."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def _try_date(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern)).cast("date")


def brazilian_date(text: Column) -> Column:
    """``dd/MM/yyyy`` or ISO; null for anything else."""
    text = F.trim(text)
    return F.coalesce(_try_date(F.when(text.rlike(r"^\d{2}/\d{2}/\d{4}$"), text), "dd/MM/yyyy"), _try_date(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text), "yyyy-MM-dd"))


def inferred_date(text: Column, as_of: datetime.date) -> Column:
    """``dd/MM`` in the year of ``as_of``, or the year before where that lies ahead; a full date as it is; else null.

    The 29th of February of a year that has none is null.
    """
    short = F.when(text.rlike(r"^\d{2}/\d{2}$"), text)
    this, last = (_try_date(F.concat(short, F.lit(f"/{as_of.year - k}")), "dd/MM/yyyy") for k in (0, 1))
    day, month = F.substring(short, 1, 2), F.substring(short, 4, 2)
    ahead = F.concat(month, day) > f"{as_of:%m%d}"
    return F.coalesce(F.when(ahead, last).otherwise(this), brazilian_date(text))


def four_digit_year(text: Column) -> Column:
    """``dd/MM/yy`` with 20 before the year; other texts as they are."""
    return F.regexp_replace(text, r"^(\d{2}/\d{2}/)(\d{2})$", "$120$2")


def age_in_years(born: Column, as_of: datetime.date) -> Column:
    had_birthday = (F.month(born) * 100 + F.dayofmonth(born)) <= as_of.month * 100 + as_of.day
    return (F.lit(as_of.year) - F.year(born) - F.when(had_birthday, 0).otherwise(1)).cast("int")


def seconds_between(start: Column, end: Column) -> Column:
    """With microseconds; null if either side is."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(end) - micros(start)) / 1e6


def hours_since(moment: Column, as_of: Column) -> Column:
    return F.floor(seconds_between(moment, as_of) / 3600).cast("long")


def duration_text(seconds: Column) -> Column:
    """``Xs``, ``Xm`` or ``Xm Ys``; blank while unfinished."""
    total = F.floor(seconds).cast("long")
    minutes, rest = F.floor(total / 60).cast("string"), (total % 60).cast("string")
    long = F.when(total % 60 == 0, F.concat(minutes, F.lit("m"))).otherwise(F.concat(minutes, F.lit("m "), rest, F.lit("s")))
    return F.when(seconds.isNull(), "").when(total < 60, F.concat(total.cast("string"), F.lit("s"))).otherwise(long)


def days_text(days: Column) -> Column:
    return F.when(days == 1, F.lit("1 dia")).otherwise(F.concat(days.cast("string"), F.lit(" dias")))


def is_weekend(day: Column) -> Column:
    """Monday is weekday 0."""
    return F.weekday(day) >= 5


def in_zone_as_utc(naive: Column, zone: str = "America/Sao_Paulo") -> Column:
    """A naive time of ``zone`` as UTC."""
    return F.to_utc_timestamp(naive, zone)


def in_days(moment: Column, first: str, last: str) -> Column:
    """Half-open range on the raw column, so that partitions are pruned."""
    return (moment >= F.lit(first).cast("date")) & (moment < F.date_add(F.lit(last).cast("date"), 1))
