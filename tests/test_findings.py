"""Queries against their SQL on tables that are larger than, or unlike, those of the other tests."""

import datetime

from pyspark.sql import functions as F

from tests.compare import connect, same
from tests.test_oracle import QUERIES, SQL


def tables(spark, folder, **frames):
    """A folder of tables: those given, the rest as in the smallest test data."""
    for source in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split():
        target = folder / f"{source}.parquet"
        if source in frames:
            frames[source].write.parquet(str(target))
        else:
            target.symlink_to(f"/root/testdata/sf0.001/{source}.parquet")
    return str(folder)


def test_last_page_of_more_than_9999(spark, tmp_path):
    sf_dir = tables(spark, tmp_path, customer=spark.range(400_100).select(F.col("id").alias("c_custkey")))
    assert same(QUERIES["o04_page"](spark, sf_dir), connect(sf_dir), SQL["o04_page"]) is None


def test_whole_amounts_of_a_census_workbook(spark, tmp_path):
    rows = [(k, datetime.datetime(2024, 1, 1, 5, k), 1, "view", float(v), "{}") for k, v in enumerate((8, 8.5, 0, 100))]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    sf_dir = tables(spark, tmp_path, events=events)
    assert same(QUERIES["s15_current_census_workbook"](spark, sf_dir), connect(sf_dir), SQL["s15_current_census_workbook"]) is None
