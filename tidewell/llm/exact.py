"""Exact dedup by an extendible-hash index kept on shared files, in DataFrame operations only.

Every row has an entry: the 64-bit hash of its normalised text, a digest, and the text's length. The directory doubles
until no bucket holds more distinct hashes than it may, and only overfull buckets split; a bucket is a range of hashes.
Copies of a text are combined to one row, so that a group with a third of all rows is a row for each task, and then go to
the task that owns their bucket. An owner walks its buckets in order of hash: texts with one hash are a chain, in which those
of equal bytes are one text. It writes each text's row of the index, and entries find theirs there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.arrow import free_name, quoted
from tidewell.session import written

#: Distinct hashes that a bucket holds before it splits.
BUCKET_HASHES = 4096


def normalised(text: Column) -> Column:
    """Without space, tab, line feed, vertical tab, form feed and carriage return; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def slot_of(key: Column, bits: int) -> Column:
    """The leading ``bits`` of a hash."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def directory(hashes: DataFrame, bucket_hashes: int = BUCKET_HASHES) -> tuple[DataFrame, int]:
    """slot, depth, bucket for each slot in use, and the bits of a slot. ``hashes``: distinct ones.

    The number of slots doubles until none is overfull. A bucket is the slots that share ``depth`` bits, named by
    the first of them; it splits, on one bit more, while it holds more than ``bucket_hashes``.
    """
    bits = max(0, math.ceil(math.log2(max(1, hashes.count()) / bucket_hashes)))
    while True:
        slots = hashes.groupBy(slot_of(F.col("hash"), bits).alias("slot")).agg(F.count("*").alias("n"))
        if bits == 64 or (slots.agg(F.max("n")).first()[0] or 0) <= bucket_hashes:
            break
        bits += 1
    slots = written(slots, "slots")
    levels = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    prefix = F.expr(f"shiftright(slot, {bits} - depth)")
    held = levels.groupBy("depth", prefix.alias("prefix")).agg(F.sum("n").alias("n"))
    overfull = held.filter(F.col("n") > bucket_hashes)
    splits = levels.withColumn("prefix", prefix).join(overfull.select("depth", "prefix"), ["depth", "prefix"], "left_semi")
    splits = splits.groupBy("slot").agg(F.max("depth").alias("last"))
    depth = F.coalesce(F.col("last") + 1, F.lit(0))
    found = slots.select("slot").join(splits, "slot", "left").select("slot", depth.alias("depth"))
    return found.withColumn("bucket", F.expr(f"shiftleft(shiftright(slot, {bits} - depth), {bits} - depth)")), bits


def indexed(docs: DataFrame, bucket_hashes: int = BUCKET_HASHES) -> tuple[DataFrame, DataFrame]:
    """Entries (doc_id, points, hash, text_sha256) of all rows, and the index: a row (bucket, depth, hash, text_sha256, group_size, keep_id, keep_points) for each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.length(text).alias("points"), normalised(F.col("text")).alias("norm"))
    rows = rows.withColumn("hash", F.xxhash64("norm"))
    entries = written(rows.select("doc_id", "points", "hash", F.sha2("norm", 256).alias("text_sha256")), "entries")
    slots, bits = directory(written(entries.select("hash").distinct(), "hashes"), bucket_hashes)
    slots = written(slots, "directory")

    combined = rows.groupBy("hash", "norm", "points").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    owned = combined.withColumn("slot", slot_of(F.col("hash"), bits)).join(slots, "slot").repartition("bucket")
    last = F.struct(-F.col("points"), F.col("doc_id").isNull(), F.col("doc_id"))
    stays = F.min(F.struct(last.alias("last"), F.col("doc_id"), F.col("points"))).alias("stays")
    chains = owned.groupBy("bucket", "hash", "norm").agg(F.first("depth").alias("depth"), F.sum("n").alias("group_size"), stays)
    index = chains.select("bucket", "depth", "hash", F.sha2("norm", 256).alias("text_sha256"), "group_size", F.col("stays.doc_id").alias("keep_id"), F.col("stays.points").alias("keep_points"))
    return entries, written(index.sortWithinPartitions("bucket", "hash"), "index")


def exact_groups(docs: DataFrame, bucket_hashes: int = BUCKET_HASHES) -> DataFrame:
    """One row for every row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, and bucket and depth in the index.

    Texts are equal when their normalised bytes are. Of equal texts the row with the most code points stays, then the
    smallest doc_id, in the order of its type; a null doc_id comes last. Null and empty texts form one group. Rows that repeat a doc_id and text count
    each and are marked alike. Texts of any length are one value; an empty table gives an empty one. Other columns are not looked at.
    """
    entries, index = indexed(docs, bucket_hashes)
    out = entries.join(index, ["hash", "text_sha256"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket", "depth")


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all its columns as they are.

    Of rows that repeat the doc_id and text that stay, one stays. Null and empty texts are one group. An empty table gives an empty one;
    columns of any name are kept.
    """
    entries, index = indexed(docs)
    sha, points, nth = (free_name(docs.columns, c) for c in ("_sha", "_points", "_nth"))
    keyed = docs.withColumns({sha: F.sha2(normalised(F.col("text")), 256), points: F.length(F.coalesce("text", F.lit("")))})
    own = [free_name(docs.columns, c) for c in ("_keep_id", "_keep_sha", "_keep_points")]
    keep = index.select(*[F.col(c).alias(n) for c, n in zip(("keep_id", "text_sha256", "keep_points"), own, strict=True)])
    same = F.col("doc_id").eqNullSafe(F.col(own[0])) & (F.col(sha) == F.col(own[1])) & (F.col(points) == F.col(own[2]))
    kept = keyed.join(keep, same, "left_semi")
    columns = [F.col(quoted(c)) for c in docs.columns]
    if entries.groupBy("doc_id", "text_sha256", "points").count().filter("count > 1").isEmpty():
        return kept.select(columns)
    order = Window.partitionBy(sha).orderBy("text", *[F.xxhash64(c.cast("string")) for c in columns])
    return kept.withColumn(nth, F.row_number().over(order)).filter(F.col(nth) == 1).select(columns)
