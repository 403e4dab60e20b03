"""Replayed batches, untouched partitions, timers, and rows against a coverage ledger."""

import datetime
import os

from pyspark.sql import functions as F

from tidewell.sources import partitions
from tidewell.streaming import stateful

T = datetime.datetime


def files_of(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def rows_of(spark, path):
    return sorted(map(tuple, spark.read.parquet(path).select("id", "day", "v").collect()))


def test_replace_parts(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(i, f"d{i % 4}", i) for i in range(40)], "id int, day string, v int")
    partitions.replace_parts(rows, path, "day")
    before = files_of(path)
    new = rows.filter("day = 'd1' AND id < 20").withColumn("v", F.col("v") * 10)
    partitions.replace_parts(new, path, "day")
    once, after = rows_of(spark, path), files_of(path)
    assert {f: t for f, t in before.items() if "day=d1" not in f} == {f: t for f, t in after.items() if "day=d1" not in f}
    assert [r for r in once if r[1] == "d1"] == [(i, "d1", i * 10) for i in range(1, 20, 4)]
    partitions.replace_parts(new, path, "day", tasks_of_a_part=3)
    assert rows_of(spark, path) == once
    partitions.replace_parts(new.limit(0), path, "day")
    assert rows_of(spark, path) == once


def test_replayed_batch_leaves_the_same(spark, tmp_path):
    """A batch that is run again, as after a lost driver, neither doubles its rows nor touches those of others."""
    path = str(tmp_path / "facts")
    rows = spark.createDataFrame([(i, "d", i) for i in range(10)], "id int, day string, v int")
    partitions.insert_batch(rows.filter("id < 5"), path, 0)
    partitions.insert_batch(rows.filter("id >= 5"), path, 1)
    first, before = rows_of(spark, path), files_of(path)
    partitions.insert_batch(rows.filter("id >= 5"), path, 1)
    assert rows_of(spark, path) == first and len(first) == 10
    assert {f: t for f, t in before.items() if "batch=0" in f} == {f: t for f, t in files_of(path).items() if "batch=0" in f}


def _streamed(spark, tmp_path, batches, schema, made):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = made(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        yield k, spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()


def test_a_job_falls_silent_without_another_beat(spark, tmp_path):
    at = lambda h, m=0: T(2024, 1, 1, h, m)
    batches = [
        [("a", at(0), "slow"), ("a", at(1), "slow"), ("b", at(1), "quick")],
        [("c", at(3), "quick")],  # b is older than its limit and its grace; a may be six hours old
        [("c", at(4), "quick"), ("a", at(5), "quick")],  # a beats in time, so its run goes on
        [("c", at(9), "quick"), ("b", at(9), "slow")],  # a's last beat is four hours old; b begins anew; c's gap is too long
    ]
    made = lambda s: stateful.silent_runs(s, {"slow": 6 * 3600}, 3600, 3600)
    seen = {k: {(r["job"], r["began"].hour, r["last_beat"].hour, r["beats"]) for r in rows} for k, rows in _streamed(spark, tmp_path, batches, "job string, at timestamp, intent string", made)}
    assert seen[0] == set() and seen[1] == seen[2] == {("b", 1, 1, 1)}
    assert seen[3] == {("b", 1, 1, 1), ("a", 0, 5, 3), ("c", 3, 4, 2)}


def test_against_coverage(spark, tmp_path):
    covered = spark.createDataFrame([(1, 10)], "who int, through int")
    batches = [[(1, 0, 10), (1, 1, 9), (1, 2, 11), (2, 3, 4)], [(1, 4, 11), (1, 5, 10), (1, 6, 13), (2, 7, 3), (2, 8, 4)]]
    made = lambda s: stateful.against_coverage(s, covered, 1)
    *_, (_, rows) = _streamed(spark, tmp_path, batches, "who int, id int, day int", made)
    assert {r["id"]: r["kind"] for r in rows} == {0: "again", 1: "late", 2: "new", 3: "new", 4: "again", 5: "late", 6: "new", 7: "late", 8: "again"}
