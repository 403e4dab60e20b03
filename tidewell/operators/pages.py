"""Pages and parameters, as the screens ask for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.places import placed

#: Rows before a page up to which it is found by the first rows in order, which one task gathers.
NEAR = 100_000
#: The lengths that a period's name stands for, in days.
PERIODS = {"24h": 1, "7d": 7, "30d": 30}


def period_days(name: str) -> int:
    """An unknown name is 24h."""
    return PERIODS.get(name, PERIODS["24h"])


def allowed(value, choices: tuple[int, ...], default: int) -> int:
    """The number if it is among the choices, else the default."""
    try:
        number = int(value)
    except (TypeError, ValueError):
        return default
    return number if number in choices else default


def day_count(value, default: int = 90) -> int:
    """A whole number from 1 on; there is no upper bound."""
    try:
        number = int(value)
    except (TypeError, ValueError):
        return default
    return number if number >= 1 else default


def page(rows: DataFrame, number, size: int, *order: str) -> DataFrame:
    """Page ``number`` from 1 in a total order; past the end the last one, the first for what is no number.

    A page far behind is found by its rows' places, so that no task gathers all rows before it.
    """
    pages = max(1, -(-rows.count() // size))
    try:
        k = int(number)
    except (TypeError, ValueError):
        k = 1
    k = pages if k < 1 or k > pages else k
    before = (k - 1) * size
    if before <= NEAR:
        return rows.orderBy(*order).offset(before).limit(size)
    places = placed(rows, [F.col(c).asc_nulls_first() for c in order], name="_place")
    return places.filter(F.col("_place").between(before, before + size - 1)).orderBy("_place").drop("_place")
