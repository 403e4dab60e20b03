"""Series against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import series


def exponential(values, span):
    alpha, out, at = 2 / (span + 1), [], None
    for i, v in enumerate(values):
        if i + 1 == span:
            at = None if None in values[:span] else sum(values[:span]) / span
        elif i + 1 > span:
            at = None if at is None or v is None else alpha * v + (1 - alpha) * at
        out.append(at)
    return out


@pytest.mark.parametrize("span", [1, 2, 7, 30])
def test_exponential_average(spark, span):
    rng = random.Random(span)
    data = {"long": [rng.uniform(-5, 90) for _ in range(4000)], "short": [1.0, 2.0], "exact": [float(n) for n in range(span)], "null": [3.0] * 40 + [None] + [3.0] * 40, None: [2.0] * 50, "zeros": [1e9] * span + [0.0] * 900}
    rows = spark.createDataFrame([(k, i, v) for k, vs in data.items() for i, v in enumerate(vs)], "k string, i int, v double")
    got = {}
    for r in series.exponential_average(rows, ["k"], "i", "v", span, "e").orderBy("k", "i").collect():
        got.setdefault(r.k, []).append(r.e)
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in data.items()}
    for k, values in data.items():
        for a, b in zip(got[k], exponential(values, span)):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-9, abs=1e-12)), (k, a, b)


def test_exponential_average_of_nothing(spark):
    rows = spark.range(0).select(F.col("id").alias("k"), F.col("id").alias("i"), F.lit(1.0).alias("v"))
    assert series.exponential_average(rows, ["k"], "i", "v", 7, "e").collect() == []
