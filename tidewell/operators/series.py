"""Ordered rows: moving averages, stays, islands, bands, concurrency and streaks.

Windows without a key run over calendars or over sums for each moment, never over raw facts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moving_average(rows: DataFrame, keys: list[str], order: str, value: str, n: int, name: str) -> DataFrame:
    """Mean of the last ``n`` rows, null until there are as many."""
    w = Window.partitionBy(*keys).orderBy(order)
    mean = F.avg(value).over(w.rowsBetween(1 - n, 0))
    return rows.withColumn(name, F.when(F.row_number().over(w) >= n, mean))


def exponential_average(rows: DataFrame, keys: list[str], order: str, value: str, span: int, name: str) -> DataFrame:
    """alpha = 2 / (span + 1), begun with the mean of the first ``span`` rows, null before and from a null value on. Equal ``order`` goes by value.

    A row's average is a sum of all terms up to it, each of which fades by ``1 - alpha`` a row. Within a block the terms are scaled by what
    they would fade, so a running sum does; a block fades what came before by 1e-100, so four blocks hold all that a double can.
    """
    alpha = 2.0 / (span + 1)
    fade = 1.0 - alpha
    block = max(1, int(100 / -math.log10(fade))) if fade else 1
    w = Window.partitionBy(*keys).orderBy(order, value)
    x, n = F.col(value).cast("double"), F.col("_n")
    out = rows.withColumns({"_n": F.row_number().over(w) - span, "_null": F.count_if(x.isNull()).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_seed": F.avg(x).over(w.rowsBetween(1 - span, 0))})
    out = out.withColumns({"_term": F.when(n == 0, F.col("_seed")).when(n > 0, alpha * x), "_block": F.floor(n / block), "_at": F.pmod(n, F.lit(block))})
    within = Window.partitionBy(*keys, "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("_sum", F.sum(F.col("_term") * F.pow(F.lit(fade), -F.col("_at"))).over(within) * F.pow(F.lit(fade), F.col("_at")))
    ends = sum((fade ** (k * block) * F.coalesce(F.lag("_sum", k * block).over(w), F.lit(0.0)) for k in range(1, 4)), F.col("_sum"))
    out = out.withColumn("_end", F.when(F.col("_at") == block - 1, ends))
    before = F.coalesce(F.last("_end", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    average = F.when((n >= 0) & (F.col("_null") == 0), F.col("_sum") + F.pow(F.lit(fade), F.col("_at") + 1) * before)
    return out.select(*keys, order, value, average.alias(name))


def change_by_day(days: DataFrame, keys: list[str], day: str, value: str, name: str) -> DataFrame:
    """Difference from the day before on a dense calendar: null if that day has none."""
    return days.withColumn(name, F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(day)))


def stays(moves: DataFrame, entity: str, day: str, order: list[str], today: Column, ended: Column | None = None) -> DataFrame:
    """``moves`` with stay (days until the next one, or until today) and is_active (the last, if it has not ended; an ended last stay is 0)."""
    w = Window.partitionBy(entity).orderBy(*order)
    following = F.lead(day).over(w)
    days = F.greatest(F.datediff(F.coalesce(following, today), F.col(day)), F.lit(0))
    ended = F.lit(False) if ended is None else ended
    out = moves.withColumn("_last", following.isNull()).withColumn("stay", days)
    return out.withColumns({"stay": F.when(F.col("_last") & ended, 0).otherwise(F.col("stay")), "is_active": F.col("_last") & ~ended}).drop("_last")


def numbered(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """sequence from 0."""
    return rows.withColumn("sequence", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def islands(days: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Runs of consecutive days: first, last, days."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(day))
    run = days.select(*keys, day).distinct().withColumn("_run", F.date_sub(day, nth))
    return run.groupBy(*keys, "_run").agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count("*").alias("days")).drop("_run")


class _Band:
    """Numbers the bands of a key's positions, which come in order, and holds nothing but where the last one began."""

    def __init__(self) -> None:
        self.key, self.begin, self.band = None, 0.0, -1

    def eval(self, row, tolerance):
        *key, position = row
        if key != self.key:
            self.key, self.band = key, -1
        if self.band < 0 or position - self.begin > tolerance:
            self.begin, self.band = position, self.band + 1
        yield (*key, position, self.band)


def bands(rows: DataFrame, keys: list[str], position: str, tolerance: float) -> DataFrame:
    """band from 0: a new one begins where a position lies more than ``tolerance`` past the begin of the last, not past its neighbour.

    The begin moves with what came before, so a table function goes through each key's different positions in order; a key is a page.
    """
    places = rows.select(*keys, F.col(position).cast("double").alias("_p")).distinct()
    kinds = ", ".join(f"_k{n} {rows.schema[k].dataType.simpleString()}" for n, k in enumerate(keys))
    numbered = F.udtf(_Band, returnType=f"{kinds}, _p double, band int")(places.asTable().partitionBy(*keys).orderBy("_p"), F.lit(float(tolerance)))
    same = F.col(position).cast("double") == F.col("_p")
    for n, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{n}"))
    return rows.join(numbered, same).select(*rows.columns, "band")


def peak_concurrency(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The most spans at once: an end counts before a start at the same moment. Changes are summed for each moment and side first."""
    ups = spans.select(*keys, F.col(start).alias("_at"), F.lit(1).alias("_d"))
    downs = spans.filter(F.col(end).isNotNull()).select(*keys, F.col(end).alias("_at"), F.lit(-1).alias("_d"))
    steps = ups.unionByName(downs).groupBy(*keys, "_at", "_d").agg(F.sum("_d").alias("_n"))
    level = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_at", "_d").rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("_level", level).groupBy(*keys).agg(F.max("_level").alias("peak"))


def until_empty_streak(rows: DataFrame, keys: list[str], order: str, empty: Column, length: int) -> DataFrame:
    """Rows up to the end of the first run of ``length`` empty ones, and how long the run of empty ones is at each."""
    w = Window.partitionBy(*keys).orderBy(order)
    run = F.sum((~empty).cast("int")).over(w)
    streak = F.sum(empty.cast("int")).over(Window.partitionBy(*keys, "_run").orderBy(order))
    marked = rows.withColumn("_run", run).withColumn("empty_streak", F.when(empty, streak).otherwise(0))
    reached = F.coalesce(F.sum((F.col("empty_streak") >= length).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("_reached", reached).filter("_reached = 0").drop("_reached", "_run")
