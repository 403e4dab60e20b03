"""Neighbours against brute force: ties, copies, odd vectors, and recall."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm.neighbours import Tree, beyond, nearest, to_boxes
from tidewell.session import written

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, every, k):
    held = []
    for i, v in dict.fromkeys((i, None if v is None else tuple(v)) for i, v in rows):
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            held.append((i, np.array(v, np.float32).astype(np.float64)))
    dims = max(len(v) for _, v in held)
    matrix = np.array([np.pad(v, (0, dims - len(v))) for _, v in held])
    norms = np.sqrt((matrix * matrix).sum(1))
    out = []
    for n, (i, _) in enumerate(held):
        if i % every == 0:
            scores = (matrix * matrix[n]).sum(1) / (norms * norms[n])
            best = sorted((-s, j) for s, (j, _) in zip(scores.tolist(), held, strict=True) if j != i)[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    return out


def recall(got, want):
    pairs = {(q, v) for q, _, v, _ in got}
    return sum((q, v) in pairs for q, _, v, _ in want) / len(want)


def test_odd_vectors_and_ties(spark):
    rng = random.Random(4)
    rows = [(k, [rng.gauss(k % 3, 1) for _ in range(12)]) for k in range(150)]
    hot = [rng.gauss(0, 1) for _ in range(12)]
    rows += [(200 + k, hot) for k in range(120)]  # a large group of copies
    rows += [(400 + k, [2 * x for x in rows[k][1]]) for k in range(5)]  # the same direction
    rows += [(500, None), (510, []), (520, [0.0] * 12), (530, [1.0, None]), (540, [float("nan")] * 12), (550, [float("inf")] + [1.0] * 11), (560, [-0.0, 1.0]), (570, [0.0, 1.0, 0.0]), (None, hot)]
    rows += [rows[0], rows[0], (10, hot), (580, [1e38] * 12), (590, [1e-40] * 12)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({c: F.lit("clash") for c in ("cell", "ids", "rank", "score", "query", "label")})
    want = brute(rows, 10, 5)
    for block in (2048, 16):
        got = sorted(map(tuple, nearest(df, 10, 5, block, missed=1e-9).collect()))
        want_ids = sorted((q, r, v) for q, r, v, _ in want if q not in (0, 10, 400))
        assert [g[:3] for g in got if g[0] not in (0, 10, 400)] == want_ids
        assert np.allclose([g[3] for g in got], [w[3] for w in sorted(want)], rtol=0, atol=1e-12)
        assert len({g[:2] for g in got}) == len(got) - 5  # id 10 has two vectors


def test_few_rows(spark):
    assert nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert nearest(spark.createDataFrame([(0, [1.0, 2.0])], SCHEMA)).count() == 0
    got = nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (7, [1.0, 0.0]), (3, [-1.0, 0.0])], SCHEMA)).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 7, 1.0), (2, 1, 0.0), (3, 3, -1.0)]


@pytest.mark.parametrize("block", [2048, 100])
def test_recall(spark, block):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    want = brute([(r["vec_id"], r["embedding"]) for r in df.collect()], 20, 5)
    got = [tuple(r) for r in nearest(df, 20, 5, block).collect()]
    assert len(got) == len(want)
    assert recall(got, want) >= 0.99


def test_tree_and_test():
    assert abs(beyond(0.05) - 15.507) < 1e-3
    points = np.random.default_rng(1).standard_normal((500, 8))
    points[100:300] = points[0]
    tree = Tree(points, 16)
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(500))
    assert all((tree.leaf_of(points[own]) == n).all() for n, own in enumerate(tree.leaves))
    assert (to_boxes(points, tree.low, tree.high)[np.arange(500), tree.leaf_of(points)] == 0).all()


def test_vectors_do_not_go_through_the_driver(spark):
    """Small tables of queries are not broadcast, and the sample comes to the driver as Arrow."""
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.standard_normal(8)]) for k in range(400)]
    out = nearest(written(spark.createDataFrame(rows, SCHEMA), "vectors"), 10, 5, block=32)
    joins = [line for line in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join [" in line]
    assert len(joins) > 1 and all("SortMergeJoin" in j or "cell" in j and "BuildRight" in j and "part" not in j for j in joins)
    assert out.count() == 200
