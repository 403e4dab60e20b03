"""Sharding by extendible hashing: a directory over hash-prefix bits, in which only oversized buckets split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.arrow import free_name
from tidewell.session import written

#: Bits of the hash that a round looks at, and all bits there are.
ROUND_BITS, ALL_BITS = 12, 60


def _prefix(bits: int):
    return F.shiftright("_hash", ALL_BITS - bits)


def shard_ids(docs: DataFrame, limit_bytes: int) -> DataFrame:
    """doc_id, n_bytes, shard, depth, shard_bytes, oversized of every row.

    The hash is the first 60 bits of md5 of doc_id as text. All rows begin in one bucket of depth 0; a
    bucket whose texts have more than ``limit_bytes`` bytes splits on the next bit, and no other does. shard is the
    bucket's depth and prefix, as ``depth-prefix``. A text above the limit ends in a shard of its own,
    and rows that repeat one doc_id can't be told apart: those shards are marked oversized.
    A null text has no bytes; a null doc_id hashes like an empty one. Empty tables give no rows.

    Each round counts bytes by ROUND_BITS more bits, so a directory round has 4096 rows for each bucket that
    is still too large, and the rows of buckets that fit are not looked at again.
    """
    md5 = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.conv(F.substring(md5, 1, ALL_BITS // 4), 16, 10).cast("long").alias("_hash"),
    )
    rows = written(rows, "shard-rows")
    open_rows, done, base = rows, None, 0
    while True:
        top = base + ROUND_BITS
        counted = open_rows.groupBy(_prefix(top).alias("fine")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("rows"))
        levels = counted.select("fine", "b", "rows", F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth"))
        buckets = levels.withColumn("prefix", F.expr(f"shiftright(fine, {top} - depth)"))
        sizes = buckets.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("rows").alias("rows"))
        buckets = buckets.drop("b", "rows").join(sizes, ["depth", "prefix"])
        # A bucket of one row can't be made smaller; at the last bit nothing can.
        fits = (F.col("shard_bytes") <= limit_bytes) | (F.col("rows") == 1) | (F.lit(top == ALL_BITS) & (F.col("depth") == top))
        own = buckets.filter(fits).groupBy("fine").agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("own"))
        own = written(own.select("fine", "own.*"), "shard-directory")
        keyed = open_rows.withColumn("fine", _prefix(top))
        placed = keyed.join(own, "fine").select("doc_id", "n_bytes", "depth", "prefix", "shard_bytes")
        done = placed if done is None else done.unionByName(placed)
        left = counted.select("fine").join(own, "fine", "left_anti")
        if top == ALL_BITS or left.isEmpty():
            break
        open_rows = written(keyed.join(left, "fine", "left_semi").drop("fine"), "shard-open")
        base = top
    shard = F.concat_ws("-", "depth", "prefix")
    return done.select("doc_id", "n_bytes", shard.alias("shard"), "depth", "shard_bytes", (F.col("shard_bytes") > limit_bytes).alias("oversized"))


def write_shards(docs: DataFrame, limit_bytes: int, path: str) -> DataFrame:
    """Writes every row of ``docs`` under ``path``, a folder for each shard, and returns doc_id and shard.

    Rows with one doc_id, or none, are in one shard. A column of ``docs`` named like the folders' ``shard`` is kept as ``_shard``.
    """
    ids = shard_ids(docs, limit_bytes).select("doc_id", "shard")
    shard = free_name(docs.columns, "_of_shard")
    placed = ids.distinct().select(F.col("doc_id").alias(free_name(docs.columns, "_of_id")), F.col("shard").alias(shard))
    rows = docs.join(placed, docs["doc_id"].eqNullSafe(placed[placed.columns[0]])).drop(placed.columns[0])
    for name in [c for c in docs.columns if c.lower() == "shard"]:
        rows = rows.withColumnRenamed(name, free_name(rows.columns, "_shard"))
    rows.withColumnRenamed(shard, "shard").repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)
    return ids
