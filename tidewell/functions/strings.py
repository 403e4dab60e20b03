"""Labels, record numbers and other short texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapsed(text: Column, upper: bool = True) -> Column:
    """Trimmed, with runs of white space as one space, in upper case unless told otherwise."""
    out = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.upper(out) if upper else out


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def phone(area: Column, number: Column) -> Column:
    """Digits of area and number; the number alone if the area is blank, blank if the number is."""
    area, number = (digits(F.coalesce(c, F.lit(""))) for c in (area, number))
    return F.when(number == "", F.lit("")).otherwise(F.concat(area, number))


def record_number(raw: Column) -> Column:
    """A record number as written by hand or by a spreadsheet: no ``.0`` at the end, no dots, slashes or outer blanks."""
    text = F.trim(F.coalesce(raw.cast("string"), F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\.0$", ""), "[./]", ""))


def is_damaged_record_number(raw: Column) -> Column:
    return F.coalesce(raw.rlike(r"\.0$|/\d+$|\.(?=\d)"), F.lit(False))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor blank, else blank."""
    return F.coalesce(*[F.when(c != "", c) for c in columns], F.lit(""))


def cut(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def without_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")


def number_in(text: Column) -> Column:
    """The digits of a text such as ``5 dias`` as a number, 0 where there are none."""
    return F.coalesce(F.nullif(F.regexp_replace(text, r"\D", ""), F.lit("")).try_cast("int"), F.lit(0))


def contains_text(text: Column, query: str) -> Column:
    """Case-insensitive; % and _ have no meaning."""
    return F.contains(F.upper(text), F.lit(query.upper()))
