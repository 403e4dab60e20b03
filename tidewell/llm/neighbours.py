"""Nearest neighbours by cosine: stable projections of few dimensions, searched as a kd-tree until a chi-square test holds.

Vectors of length one are projected on PROJECTIONS Gaussian directions. A projected squared distance is then the true one times a chi-square
variable, so a point as near as the k-th best so far, at d, is projected beyond r with the probability that chi-square is above r2 / d2.
A search takes projected neighbours from near to far, and compares their true cosines, until that probability is MISSED or less.

The tree's upper splits are fitted to a bounded sample and deal out all vectors to cells; a cell is cut into blocks, and each block is
searched through a kd-tree of its own. Every query is first searched in its own block. That gives it a distance to beat, with which the
test leaves cells and blocks out as wholes; the others are searched in a second wave.

Joins by vectors are told to sort and merge, so that vectors never go through the driver, however few Spark takes them to be.

Equal vectors are one class, so a group of copies is one point of the tree and one search. Of a class only its k + 1 smallest ids can be
among the k nearest of any query, so a search needs no others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.arrow import bounded_batches, mixed
from tidewell.session import written

#: Dimensions of a projection, and the probability with which one neighbour may be missed.
PROJECTIONS, MISSED = 8, 0.001
#: Classes that the upper splits are fitted to, at most; how many of them a cell holds at least.
SAMPLE, CELL_SAMPLE = 1 << 17, 64
#: Classes in a block, and below a leaf of a block's tree.
BLOCK, LEAF = 2048, 32
#: Queries that are sent to a block together.
QUERIES = 256


def beyond(probability: float, dims: int = PROJECTIONS) -> float:
    """The value that chi-square of an even number of dimensions exceeds with ``probability``."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        above = math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(dims // 2))
        low, high = (x, high) if above > probability else (low, x)
    return high


@cache
def directions(dims: int) -> np.ndarray:
    return np.random.default_rng(20_130 + dims).standard_normal((dims, PROJECTIONS))


class Vectors:
    """Some vectors of one class each: in full, of length one, and projected."""

    def __init__(self, column: pa.Array, dims: int):
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        lengths = np.asarray(column.value_lengths())
        if (lengths == dims).all():
            self.raw = values.reshape(len(column), dims)
        else:
            self.raw = np.zeros((len(column), dims))
            row = np.repeat(np.arange(len(column)), lengths)
            self.raw[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
        scaled = self.raw / np.abs(self.raw).max(1, initial=1e-300)[:, None]
        self.unit = scaled / np.sqrt((scaled * scaled).sum(1))[:, None]
        self.at = (self.unit[:, :, None] * directions(dims)[None]).sum(1) if len(column) < 64 else self.unit @ directions(dims)


class Tree:
    """A kd-tree over projected points: splits at medians down to ``leaf`` points; of leaves, their points and bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.splits: dict[int, tuple[int, float]] = {}
        self.leaves: list[np.ndarray] = []
        self.number: dict[int, int] = {}
        todo = [(1, np.arange(len(points)))]
        while todo:
            node, own = todo.pop()
            if len(own) > leaf:
                spread = np.ptp(points[own], axis=0)
                axis = int(spread.argmax())
                values = points[own, axis]
                middle = float(np.partition(values, len(own) // 2)[len(own) // 2])
                left = values < middle
                if left.any():
                    self.splits[node] = (axis, middle)
                    todo += [(2 * node, own[left]), (2 * node + 1, own[~left])]
                    continue
                if spread[axis] > 0:  # most points are at the least value
                    above = float(values[values > middle].min())
                    self.splits[node] = (axis, above)
                    todo += [(2 * node, own[values < above]), (2 * node + 1, own[values >= above])]
                    continue
            self.number[node] = len(self.leaves)
            self.leaves.append(own)
        self.low = np.array([points[own].min(0) for own in self.leaves if len(own)])
        self.high = np.array([points[own].max(0) for own in self.leaves if len(own)])

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each point falls into."""
        out = np.zeros(len(points), np.int64)
        todo = [(1, np.arange(len(points)))]
        while todo:
            node, own = todo.pop()
            if node not in self.splits:
                out[own] = self.number[node]
            elif len(own):
                axis, middle = self.splits[node]
                left = points[own, axis] < middle
                todo += [(2 * node, own[left]), (2 * node + 1, own[~left])]
        return out


def to_boxes(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances from each point to each box."""
    out = np.zeros((len(points), len(low)))
    for k in range(points.shape[1]):
        p = points[:, k : k + 1]
        out += np.square(np.maximum(0, np.maximum(low[:, k] - p, p - high[:, k])))
    return out


def cosines(vectors: Vectors, rows: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Cosines in double precision of some rows and one vector, on the vectors as they are; a row's is the same whatever rows stand beside it."""
    own = vectors.raw[rows]
    with np.errstate(over="ignore", invalid="ignore", divide="ignore", under="ignore"):
        found = (own * raw).sum(1) / (np.sqrt((own * own).sum(1)) * np.sqrt((raw * raw).sum()))
        odd = ~np.isfinite(found)
        if odd.any():  # squares outside the range of doubles
            a, b = own[odd] / np.abs(own[odd]).max(1)[:, None], raw / np.abs(raw).max()
            found[odd] = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum()))
    return found


class Near:
    """The k nearest so far of one query: (-cosine, id) of classes' ids, in order."""

    def __init__(self, k: int, reach: float = 2.0):
        self.k, self.best, self.reach = k, [], reach

    def take(self, scores: np.ndarray, ids: list[list[int]]) -> None:
        self.best = sorted([*self.best, *((-s, i) for s, own in zip(scores.tolist(), ids, strict=True) for i in own)])[: self.k]
        if len(self.best) == self.k:
            self.reach = min(self.reach, _reach(-self.best[-1][0]))


def _reach(cosine: float) -> float:
    """Squared distance of unit vectors, with room for rounding, so that ties are looked at."""
    return max(0.0, 2 - 2 * cosine) + 1e-9


def search(tree: Tree, points: Vectors, ids: list[list[int]], raw: np.ndarray, at: np.ndarray, near: Near, test: float) -> int:
    """Looks through one block for one query; gives the number of classes whose cosines were compared."""
    bound = to_boxes(at[None], tree.low, tree.high)[0]
    order = np.argsort(bound, kind="stable")
    bound = bound[order]
    compared, step, k = 0, 1, 0
    while k < len(order) and bound[k] <= test * near.reach:
        to = min(k + step, int(np.searchsorted(bound, test * near.reach, "right")))
        own = np.concatenate([tree.leaves[n] for n in order[k:to]])
        own = own[np.square(points.at[own] - at).sum(1) <= test * near.reach]
        if len(own):
            scores = cosines(points, own, raw)
            close = scores >= (-near.best[-1][0] if len(near.best) == near.k else -2.0)
            near.take(scores[close], [ids[n] for n in own[close]])
            compared += len(own)
        k, step = to, step * 2
    return compared


def _valid(embedding: Column) -> Column:
    """Neither null nor without a length or holding a null, NaN or infinite component."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & (~F.isnan(x)) & (F.abs(x) < F.lit(float("inf"))))
    return embedding.isNotNull() & finite & F.exists(embedding, lambda x: x != 0)


def classes(vectors: DataFrame, every: int, k: int) -> DataFrame:
    """embedding, ids, asked: each different vector once, with its k + 1 smallest ids, and whether a query has it."""
    rows = vectors.select("vec_id", "embedding").distinct()
    first = Window.partitionBy("embedding").orderBy(F.col("vec_id").asc_nulls_last())
    held = rows.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k + 1)
    held = held.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = rows.filter(F.col("vec_id") % every == 0).select("embedding").distinct().withColumn("asked", F.lit(True))
    return held.join(asked.hint("merge"), "embedding", "left").select("embedding", "ids", F.coalesce("asked", F.lit(False)).alias("asked"))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, block: int = BLOCK, missed: float = MISSED) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by ``every``, among all other rows.

    Nearness is the cosine of the vectors as given, in double precision; ties go to the smaller vec_id. Vectors that are null, empty, zero, or
    that hold a null, NaN or infinite component take no part, nor do rows without a vec_id. Shorter vectors count as ending in zeros.
    Rows that repeat vec_id and vector are one. One vec_id with several vectors is several rows, each with a search of its own; they are no
    candidates of each other, but take up places of the k + 1 that a search keeps. An empty table gives none. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & _valid(F.col("embedding")))
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))  # no negative zero
    dims = rows.agg(F.max(F.size("embedding"))).first()[0]
    if dims is None:
        return spark.createDataFrame([], schema)
    found_classes = written(classes(rows, every, k), "classes")

    # the upper splits
    wanted = found_classes.count()

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = Vectors(b.column("embedding"), dims).at
                yield pa.RecordBatch.from_arrays([b.column("hash"), pa.FixedSizeListArray.from_arrays(pa.array(at.ravel()), PROJECTIONS).cast(pa.list_(pa.float64()))], ["hash", "at"])

    sample = found_classes.select("embedding", F.xxhash64("embedding").alias("hash")).mapInArrow(projected, "hash long, at array<double>")
    if wanted > SAMPLE:
        sample = sample.orderBy("hash").limit(SAMPLE)
    # As Arrow, in which SAMPLE projections are 8 MiB, in Spark's driver as in Python; as rows they would be many times that.
    points = sample.select("at").toArrow().column("at").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, PROJECTIONS)
    per_cell = max(CELL_SAMPLE, math.ceil(len(points) * block / wanted))
    upper = spark.sparkContext.broadcast(Tree(points, per_cell))

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 32
        for b in batches:
            if b.num_rows:
                at = Vectors(b.column("embedding"), dims).at
                salt = mixed(np.arange(n, n + b.num_rows).astype(np.uint64)) >> np.uint64(33)
                n += b.num_rows
                yield b.append_column("cell", pa.array(upper.value.leaf_of(at).astype(np.int32))).append_column("salt", pa.array(salt.astype(np.int64)))

    kept = "embedding array<double>, ids array<long>, asked boolean"
    cells = written(found_classes.mapInArrow(celled, f"{kept}, cell int, salt long"), "cells")
    parts = cells.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("parts"))
    cells = cells.join(F.broadcast(parts), "cell").withColumn("part", F.col("salt") % F.col("parts"))
    packed = cells.groupBy("cell", "part").agg(F.collect_list(F.struct("embedding", "ids", "asked")).alias("rows"))
    packed = written(packed, "blocks")
    test = beyond(missed)

    def opened(row: pa.StructScalar) -> tuple[pa.StructArray, Vectors, Tree, list[list[int]]]:
        own = row.values
        points = Vectors(own.field("embedding"), dims)
        return own, points, Tree(points.at, LEAF), own.field("ids").to_pylist()

    def own_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query class in its own block; a block without one gives a row that has only its box."""
        for b in batches:
            for cell, part, rows in zip(b.column("cell").to_pylist(), b.column("part").to_pylist(), b.column("rows"), strict=True):
                own, points, tree, ids = opened(rows)
                asked = np.flatnonzero(own.field("asked").to_numpy(zero_copy_only=False))
                box = [points.at.min(0).tolist() + points.at.max(0).tolist()]
                results = []
                for q in asked.tolist():
                    near = Near(k + 1)
                    search(tree, points, ids, points.raw[q], points.at[q], near, test)
                    results.append(near)
                n = max(1, len(asked))
                queries = own.field("embedding").take(pa.array(asked)) if len(asked) else pa.array([None], pa.list_(pa.float64()))
                columns = [pa.array([cell] * n, pa.int32()), pa.array([part] * n, pa.int64()), queries, pa.array([r.reach for r in results] or [0.0])]
                columns += [pa.array([[i for _, i in r.best] for r in results] or [[]], pa.list_(pa.int64())), pa.array([[-s for s, _ in r.best] for r in results] or [[]], pa.list_(pa.float64()))]
                columns.append(pa.array(box + [[]] * (n - 1), pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays(columns, ["cell", "part", "query", "reach", "ids", "scores", "box"])

    wave = "cell int, part long, query array<double>, reach double, ids array<long>, scores array<double>, box array<double>"
    first = written(packed.mapInArrow(own_block, wave), "own-blocks")
    edge = [f(F.element_at("box", j + 1 + s * PROJECTIONS)).alias(f"{'lh'[s]}{j}") for s, f in ((0, F.min), (1, F.max)) for j in range(PROJECTIONS)]
    boxes = first.filter(F.size("box") > 0).groupBy("cell").agg(F.count("*").alias("parts"), *edge).orderBy("cell").collect()  # a row for each cell
    low, high = (np.array([[r[f"{s}{j}"] for j in range(PROJECTIONS)] for r in boxes]) for s in "lh")
    shared = spark.sparkContext.broadcast((np.array([r["cell"] for r in boxes]), np.array([r["parts"] for r in boxes]), low, high))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries packed for each block that the test doesn't leave out."""
        cell_of, n_parts, low, high = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, QUERIES):
                b = batch.slice(start, QUERIES)
                at, reach = Vectors(b.column("query"), dims).at, b.column("reach").to_numpy()
                own_cell, own_part = b.column("cell").to_numpy(), b.column("part").to_numpy()
                goes = to_boxes(at, low, high) <= test * reach[:, None]
                for c in np.flatnonzero(goes.any(0)).tolist():
                    of = np.flatnonzero(goes[:, c])
                    for part in range(int(n_parts[c])):
                        sent = of[(own_cell[of] != cell_of[c]) | (own_part[of] != part)]
                        if len(sent):
                            take = pa.array(sent)
                            queries = pa.StructArray.from_arrays([b.column("query").take(take), b.column("reach").take(take)], ["query", "reach"])
                            packs = pa.ListArray.from_arrays(pa.array([0, len(sent)], pa.int32()), queries)
                            yield pa.RecordBatch.from_arrays([pa.array([cell_of[c]], pa.int32()), pa.array([part], pa.int64()), packs], ["cell", "part", "queries"])

    def other_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, sent in zip(b.column("rows"), b.column("queries"), strict=True):
                _, points, tree, ids = opened(rows)
                queries = Vectors(sent.values.field("query"), dims)
                results = []
                for q, reach in enumerate(sent.values.field("reach").to_pylist()):
                    near = Near(k + 1, reach)
                    search(tree, points, ids, queries.raw[q], queries.at[q], near, test)
                    results.append(near)
                hits = [pa.array([[i for _, i in r.best] for r in results], pa.list_(pa.int64())), pa.array([[-s for s, _ in r.best] for r in results], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([sent.values.field("query"), *hits], ["query", "ids", "scores"])

    queries = first.filter("query IS NOT NULL").select("cell", "part", "query", "reach")
    queries = queries.repartitionByRange("cell").sortWithinPartitions("cell", "part")  # queries of a cell visit the same cells
    sent = queries.mapInArrow(visits, "cell int, part long, queries array<struct<query: array<double>, reach: double>>")
    second = packed.join(sent.hint("merge"), ["cell", "part"]).select("rows", "queries").mapInArrow(other_blocks, "query array<double>, ids array<long>, scores array<double>")
    every_hit = first.filter("query IS NOT NULL").select("query", "ids", "scores").union(second)
    hits = every_hit.select("query", F.explode(F.arrays_zip("ids", "scores")).alias("h")).select("query", F.col("h.ids").alias("vec_id"), F.col("h.scores").alias("score"))
    nth = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    hits = hits.withColumn("nth", F.row_number().over(nth)).filter(F.col("nth") <= k + 1)
    hits = hits.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("hits"))
    asked = rows.filter(F.col("vec_id") % every == 0).distinct().select(F.col("vec_id").alias("query_id"), "embedding")
    others = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    out = asked.join(hits.hint("merge"), asked["embedding"] == hits["query"]).select("query_id", F.posexplode(others).alias("rank", "h"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "h.vec_id", "h.score")
