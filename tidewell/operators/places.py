"""Places of rows in an order of the whole table, or of the rows of a key, without a task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import written


def placed(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "place") -> DataFrame:
    """``df`` with each row's place from 0 on in ``order``, among the rows with its values of ``by`` (nulls are one value).

    Rows are dealt to tasks by ranges of ``by`` and ``order`` and counted there; the counts of earlier ranges give each range its offset. So a
    key with most rows is spread over tasks. Rows that are alike in ``order`` have places of any order among them.
    """
    keys = [F.col(c).asc_nulls_first() for c in by]
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    ranged = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "places")
    ranged = ranged.withColumn("_part", F.shiftrightunsigned("_at", 33))  # the partition's number, which goes with the ranges
    counts = ranged.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    if by:
        before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    else:  # a row for each task
        total, rows = 0, []
        for r in sorted(counts.collect(), key=lambda r: r["_part"]):
            rows.append((r["_part"], r["_first"], total))
            total += r["_n"]
        offsets = df.sparkSession.createDataFrame(rows, "_part long, _first long, _before long")
    offsets = offsets.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.col("_part").alias("_of"), "_first", "_before")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)], F.col("_part") == F.col("_of"))
    place = F.col("_at") - F.col("_first") + F.col("_before")
    return ranged.join(offsets if by else F.broadcast(offsets), same).select(*df.columns, place.alias(name))
