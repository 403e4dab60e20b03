"""Writes that replace partitions, so that a batch that is run again leaves what it left before, and other partitions keep their files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def replace_parts(rows: DataFrame, path: str, part: str, tasks_of_a_part: int = 1) -> None:
    """Replaces the partitions of ``part`` that ``rows`` has, and no others. A partition without rows is not touched.

    A part's rows go to ``tasks_of_a_part`` tasks, so that a part with most of them is spread.
    """
    salt = [F.pmod(F.xxhash64(*rows.columns), F.lit(tasks_of_a_part))] if tasks_of_a_part > 1 else []
    rows.repartition(part, *salt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def insert_batch(rows: DataFrame, path: str, batch: int) -> None:
    """Bulk insert of one batch under its number: run again, it replaces its own rows."""
    rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def inserting(stream: DataFrame, path: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Inserts each batch of a stream; ``then`` is called after it, with the batch and its number."""

    def put(batch: DataFrame, number: int) -> None:
        insert_batch(batch, path, number)
        if then:
            then(batch, number)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replacing(stream: DataFrame, path: str, checkpoint: str, part: str) -> StreamingQuery:
    """Replaces the parts that each batch of a stream brings."""
    return stream.writeStream.foreachBatch(lambda batch, _: replace_parts(batch, path, part)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rebuild_parts(spark: SparkSession, facts: DataFrame, touched: DataFrame, part: str, summary: Callable[[DataFrame], DataFrame], path: str) -> None:
    """Makes the summaries of the parts in ``touched`` again, from all facts of those parts, and replaces them."""
    replace_parts(summary(facts.join(touched.select(part).distinct(), part, "left_semi")), path, part)
