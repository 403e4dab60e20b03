"""Snapshots and events that arrive one by one, with Structured Streaming.

Each batch is merged by the batch operators, so that a stream that has caught up gives what one batch would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidewell.operators.ledger import ledger_actions


def latest_snapshot(stream: DataFrame, path: str, checkpoint: str, captured: str) -> StreamingQuery:
    """Writes the newest capture of each batch to a folder of its own below ``path``, which a batch that is run again overwrites; see ``newest_rows``."""

    def keep(batch: DataFrame, epoch: int) -> None:
        newest = batch.agg(F.max(captured).alias("n"), F.max(F.unix_micros(F.col(captured).cast("timestamp"))).alias("micros")).first()
        if newest["n"] is not None:
            batch.filter(F.col(captured) == newest["n"]).write.mode("overwrite").parquet(f"{path}/capture={newest['micros']}/epoch={epoch}")

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest capture that ``latest_snapshot`` has written; folders of older ones are not read."""
    rows = spark.read.parquet(path)
    newest = rows.select("capture").distinct().agg(F.max("capture")).first()[0]
    return rows.filter(F.col("capture") == newest).drop("capture", "epoch")


def ledger_stream(stream: DataFrame, path: str, checkpoint: str, order: str, buckets: int = 64) -> StreamingQuery:
    """Appends what the ledger has not seen; a batch that is run again is skipped whole, since its contents are there.

    The ledger is partitioned by buckets of identities, and a batch reads those of its own identities.
    """
    bucket = F.pmod(F.xxhash64("identity"), F.lit(buckets)).cast("int")
    schema = T.StructType([*stream.schema.fields, T.StructField("bucket", T.IntegerType())])

    def append(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
        ledger = spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
        met = [r[0] for r in batch.select(bucket).distinct().collect()]
        known = ledger.filter(F.col("bucket").isin(met)).join(batch.select("identity").distinct(), "identity", "left_semi")
        new = ledger_actions(batch, known.select("identity", "content"), order).filter("action <> 'skipped'").drop("action")
        new.withColumn("bucket", bucket).write.mode("append").partitionBy("bucket").parquet(path)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_events(stream: DataFrame, at: str, keys: list[str], delay: str) -> DataFrame:
    """Each event once, within the delay by which its copies may come late."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def counts_by_window(stream: DataFrame, at: str, by: str, length: str, delay: str) -> DataFrame:
    """Counts of tumbling windows; rows later than the delay no longer count."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, length), by).agg(F.count("*").alias("n"))


def touched_days(batch: DataFrame, captured: str) -> DataFrame:
    """The days that a late batch completes, by when it was captured, not when it came: only these partitions are computed again."""
    return batch.select(F.to_date(captured).alias("day")).distinct()
