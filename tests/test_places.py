"""Places over a table, and the folder for written steps where none is set."""

import os
import subprocess
import sys

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators.places import placed


def test_places_in_table_and_key(spark):
    rows = [(k % 3 if k % 5 else None, (k * 37) % 101) for k in range(400)] + [(1, 7)] * 300
    df = spark.createDataFrame(rows, "k long, v long").repartition(7)
    got = [(r["v"], r["place"]) for r in placed(df, [F.col("v")]).collect()]
    assert sorted(p for _, p in got) == list(range(700))
    assert [v for v, _ in sorted(got, key=lambda x: x[1])] == sorted(v for _, v in rows)
    got = placed(df, [F.col("v").desc()], ["k"]).collect()
    for k in (None, 0, 1, 2):
        own = sorted((r["place"], r["v"]) for r in got if r["k"] == k)
        assert [p for p, _ in own] == list(range(len(own)))
        assert [v for _, v in own] == sorted((v for key, v in rows if key == k), reverse=True)


def test_places_of_nothing(spark):
    df = spark.createDataFrame([], T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.LongType())]))
    assert placed(df, [F.col("v")]).count() == placed(df, [F.col("v")], ["k"]).count() == 0


def test_written_without_a_set_folder(tmp_path):
    code = """
from tidewell.session import local_session, written
spark = local_session("1", 2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert written(spark.range(5), "five").count() == written(spark.range(5), "five").count() == 5
"""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], check=True, env=env, timeout=300)
