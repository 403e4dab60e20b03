"""Percentages rounded half up, token costs, and money as it is written in Brazil."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dollars per thousand tokens read and written (fixed values).
PRICE_IN, PRICE_OUT = "0.005", "0.015"


def percentage(part: Column, whole: Column) -> Column:
    """Decimal with two places, rounded half up; null where the whole is 0 or null."""
    ratio = part.cast("decimal(20,0)") * 100 / F.nullif(whole, F.lit(0)).cast("decimal(20,0)")
    return F.round(ratio, 2).cast("decimal(12,2)")


def token_cost(read: Column, written: Column) -> Column:
    cost = lambda n, price: n.cast("decimal(18,0)") * F.lit(price).cast("decimal(6,3)") / 1000
    return (cost(read, PRICE_IN) + cost(written, PRICE_OUT)).cast("decimal(18,6)")


def reported_or_estimated(reported: Column, estimated: Column) -> Column:
    """Sum of what is reported if any is and it is above 0, else of what is estimated."""
    total = F.sum(reported)
    return F.when(F.bool_or(reported.isNotNull()) & (total > 0), total).otherwise(F.sum(estimated))


def brl(amount: Column) -> Column:
    """``R$ 1.234,56``, ``---`` for null."""
    plain = F.format_number(amount.cast("decimal(18,2)"), 2)
    return F.coalesce(F.concat(F.lit("R$ "), F.translate(plain, ",.", ".,")), F.lit("---"))
