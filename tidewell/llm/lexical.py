"""Ranked search for the best documents of each item, by max trees over ranges of documents.

The index is a row for each block of texts: its documents in the order of doc_id, the hashes of its terms, and each term's postings. A search
knows, for each term, the largest value that a document can add: of a block, of 512 documents, of 64 documents, one tree for each term. The
sum of an item's terms bounds every score below a node. A search descends best-first, and stops at nodes whose bound is below the k-th best
score so far; nodes whose bound equals it are opened, as a tie goes to the smaller doc_id.

Blocks are the trees' upper level, which Spark works on in two waves: each item's blocks of the highest bounds give it a score to beat, then
every block opens the items whose bound reaches that.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewell.llm.arrow import bounded_batches, ids_of, ids_stream, lowered, span_hashes, text_slices, unzipped, word_spans, zipped
from tidewell.llm.decontaminate import IS_WORD
from tidewell.llm.packing import gathered
from tidewell.session import written

#: Bytes of text in a block; a longer text has one of its own.
BLOCK_BYTES = 4 << 20
#: Bytes of items that are searched for in one pass over the index, and held by each task.
ITEM_BYTES = 8 << 20
#: Documents below a leaf of the trees, and children of a node above.
LEAF_DOCS, FANOUT = 64, 8
#: Blocks that the first wave opens for each item.
SEEDS = 2

_INDEX = "block long, n_docs long, n_terms long, ids binary, lengths binary, terms binary, at binary, rows binary, counts binary"


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every term, and the terms before each text."""
    low = lowered(data)
    starts, ends, word_at = word_spans(IS_WORD[low], offsets)
    return span_hashes(low, starts, ends), word_at


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Places where a row differs from the one before, the first one included."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def indexed(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The index of ``docs``, written: a row for each block. Terms are told apart by 62-bit hashes of their bytes."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for rows, data, offsets in text_slices(batches, limit=block_bytes):
            hashes, word_at = _terms(data, offsets)
            order = pc.sort_indices(rows.column("doc_id"), null_placement="at_end").to_numpy().astype(np.int64)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            lengths = np.diff(word_at)
            by_hash = np.lexsort((np.repeat(rank, lengths), hashes))
            h, r = hashes[by_hash], np.repeat(rank, lengths)[by_hash]
            first = _changes(h, r)
            counts = np.diff(np.append(first, len(h)))
            h, r = h[first], r[first]
            first = _changes(h)
            row = [block, int((lengths > 0).sum()), int(lengths.sum()), ids_stream(rows.take(pa.array(order))), zipped(lengths[order].astype(np.int64)), zipped(h[first])]
            row += [zipped(np.append(first, len(h)).astype(np.int64)), zipped(r.astype(np.int32)), zipped(counts.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], ["block", "n_docs", "n_terms", "ids", "lengths", "terms", "at", "rows", "counts"])
            block += 1

    bounded_batches(docs.sparkSession)
    return written(docs.select("doc_id", "text").mapInArrow(build, _INDEX), "lexical")


class Items:
    """Some items' distinct terms: ``terms`` sorted, and of item k those numbered of[at[k]:at[k + 1]]."""

    def __init__(self, texts: list[str]):
        raw = pa.array(texts, pa.large_string()).cast(pa.large_binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[: len(texts) + 1]
        hashes, word_at = _terms(np.frombuffer(raw.buffers()[2] or b"", np.uint8), offsets)
        self.terms, number = np.unique(hashes, return_inverse=True)
        pairs = np.unique(np.repeat(np.arange(len(texts)), np.diff(word_at)) * max(1, len(self.terms)) + number)
        self.of = pairs % max(1, len(self.terms))
        self.at = np.searchsorted(pairs, np.arange(len(texts) + 1) * max(1, len(self.terms)))


class Block:
    """A block's postings of the items' terms; a posting's value is what it adds to a score, without the term's weight."""

    def __init__(self, row: dict, items: Items, n_docs: int, n_terms: int):
        lengths, terms, at = (unzipped(row[c], k) for c, k in (("lengths", np.int64), ("terms", np.uint64), ("at", np.int64)))
        place = np.minimum(np.searchsorted(terms, items.terms), max(0, len(terms) - 1))
        self.present = np.flatnonzero(terms[place] == items.terms) if len(terms) else np.zeros(0, np.int64)
        place = place[self.present]
        self.df = at[place + 1] - at[place]
        self.at = np.append(0, np.cumsum(self.df))
        rows, counts = (gathered(at[place], self.df, unzipped(row[c], k)) for c, k in (("rows", np.int32), ("counts", np.int64)))
        scaled = [10 + 90 * n * n_docs // n_terms for n in lengths.tolist()]  # whole numbers of any size
        self.rows, self.n = rows.astype(np.int64), len(lengths)
        self.values = 1_000_000_000 * counts // (1000 * counts + 8 * np.array(scaled, np.int64)[self.rows])
        self.top = np.maximum.reduceat(self.values, self.at[:-1]) if len(self.df) else self.df
        self.local = np.full(len(items.terms), -1)
        self.local[self.present] = np.arange(len(self.present))

    def bounds(self, items: Items, weights: np.ndarray) -> np.ndarray:
        """The most that a document of the block can score, for each item."""
        top = np.zeros(len(items.terms), np.int64)
        top[self.present] = self.top
        sums = np.append(0, np.cumsum((weights * top)[items.of]))
        return sums[items.at[1:]] - sums[items.at[:-1]]

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[list[tuple[int, int]], int]:
        """(-score, row) of the k best documents that score ``floor`` or more, the best first; and how many leaves were opened."""
        local = self.local[terms]
        terms, local = terms[local >= 0], local[local >= 0]
        df = self.df[local]
        rows, values = (gathered(self.at[local], df, v) for v in (self.rows, self.values))
        values = values * np.repeat(weights[terms], df)
        n_leaves = -(-self.n // LEAF_DOCS)
        width = FANOUT ** max(0, math.ceil(math.log(n_leaves, FANOUT) - 1e-9)) if n_leaves > 1 else 1
        leaf = np.zeros(len(terms) * width, np.int64)
        np.maximum.at(leaf, np.repeat(np.arange(len(terms)) * width, df) + rows // LEAF_DOCS, values)
        levels = [leaf.reshape(len(terms), width)]
        while levels[-1].shape[1] > 1:
            levels.append(levels[-1].reshape(len(terms), -1, FANOUT).max(2))
        by_leaf = np.argsort(rows // LEAF_DOCS, kind="stable")
        edges = np.searchsorted((rows // LEAF_DOCS)[by_leaf], np.arange(n_leaves + 1))
        best: list[tuple[int, int]] = []
        opened = 0
        heap = [(-int(levels[-1].sum()), len(levels) - 1, 0)]
        while heap and -heap[0][0] >= floor:
            _, level, node = heapq.heappop(heap)
            if level:
                below = levels[level - 1][:, node * FANOUT : (node + 1) * FANOUT].sum(0)
                for child in np.flatnonzero(below >= floor).tolist():
                    heapq.heappush(heap, (-int(below[child]), level - 1, node * FANOUT + child))
                continue
            opened += 1
            own = by_leaf[edges[node] : edges[node + 1]]
            scores = np.zeros(LEAF_DOCS, np.int64)
            np.add.at(scores, rows[own] % LEAF_DOCS, values[own])
            for row in np.flatnonzero(scores >= floor).tolist():
                best.append((-int(scores[row]), node * LEAF_DOCS + row))
            best = sorted(best)[:k]
            if len(best) == k:
                floor = max(floor, -best[-1][0])
        return best, opened


def _passes(items: DataFrame, item_bytes: int) -> Iterator[list[Row]]:
    """Distinct items by so many bytes."""
    held, size = [], 0
    for row in items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct().toLocalIterator():
        held.append(row)
        size += len(row["text"].encode())
        if size >= item_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked_in(index: DataFrame, items: DataFrame, doc_id: T.DataType, k: int = 10, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score of ``items`` in an index that is there already."""
    spark, kind, id_type, id_arrow = index.sparkSession, doc_id.simpleString(), items.schema["item_id"].dataType, to_arrow_type(doc_id)
    schema = T.StructType([T.StructField("item_id", id_type), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", doc_id), T.StructField("score", T.LongType())])
    total = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = total[0] or 0, total[1] or 0
    found = spark.createDataFrame([], schema)
    if not n_terms:
        return found
    for batch in _passes(items, item_bytes):
        held = Items([r["text"] for r in batch])
        shared = spark.sparkContext.broadcast(held)

        def tops(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                for row in rows.to_pylist():
                    b = Block(row, shared.value, n_docs, n_terms)
                    yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), *(pa.array([v.tolist()], pa.list_(pa.int64())) for v in (b.present, b.df, b.top))], ["block", "term", "df", "top"])

        stats = written(index.select("block", "lengths", "terms", "at", "rows", "counts").mapInArrow(tops, "block long, term array<long>, df array<long>, top array<long>"), "tops")
        df = np.zeros(len(held.terms), np.int64)
        for r in stats.select(F.explode(F.arrays_zip("term", "df")).alias("t")).groupBy("t.term").agg(F.sum("t.df").alias("df")).collect():
            df[r["term"]] = r["df"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)

        def bounds(batches: Iterator[pa.RecordBatch], shared=shared, weights=weights) -> Iterator[pa.RecordBatch]:
            """Each item's blocks of the highest bounds among the task's."""
            items = shared.value
            bound, block = (np.zeros((SEEDS + 1, len(items.at) - 1), np.int64) for _ in range(2))
            for rows in batches:
                for row in rows.to_pylist():
                    top = np.zeros(len(items.terms), np.int64)
                    top[np.array(row["term"], np.int64)] = row["top"]
                    sums = np.append(0, np.cumsum((weights * top)[items.of]))
                    bound[SEEDS], block[SEEDS] = sums[items.at[1:]] - sums[items.at[:-1]], row["block"]
                    order = np.argsort(-bound, axis=0, kind="stable")
                    bound, block = np.take_along_axis(bound, order, 0), np.take_along_axis(block, order, 0)
            of, item = np.nonzero(bound[:SEEDS])
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (item, block[of, item], bound[of, item])], ["item", "block", "bound"])

        nth = F.row_number().over(Window.partitionBy("item").orderBy(F.col("bound").desc(), "block"))
        seeds = stats.select("block", "term", "top").mapInArrow(bounds, "item long, block long, bound long").withColumn("nth", nth).filter(F.col("nth") <= SEEDS)
        seeds = written(seeds.groupBy("block").agg(F.collect_list("item").alias("items")), "seeds")  # at most SEEDS numbers for each item of the pass

        def wave(floor: np.ndarray | None, shared=shared, weights=weights):
            def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                items = shared.value
                for rows in batches:
                    for row in rows.to_pylist():
                        b = Block(row, items, n_docs, n_terms)
                        if floor is None:
                            open_items = np.array(row["items"], np.int64)
                        else:
                            reach = b.bounds(items, weights) >= floor
                            reach[np.array(row["items"] or (), np.int64)] = False
                            open_items = np.flatnonzero(reach)
                        out: list[tuple[int, int, int]] = []
                        for item in open_items.tolist():
                            best, _ = b.search(items.of[items.at[item] : items.at[item + 1]], weights, k, 1 if floor is None else int(floor[item]))
                            out += [(item, r, -s) for s, r in best]
                        if out:
                            cols = np.array(out, np.int64).T
                            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), ids_of(row["ids"], id_arrow).take(pa.array(cols[1])), pa.array(cols[2])], ["item", "doc_id", "score"])

            return search

        columns = ["block", "ids", "lengths", "terms", "at", "rows", "counts", "items"]
        out_schema = f"item long, doc_id {kind}, score long"
        first = index.join(F.broadcast(seeds), "block").select(columns).mapInArrow(wave(None), out_schema)
        first = written(_best(first, k), "first-wave")
        floor = np.ones(len(batch), np.int64)
        for r in first.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == k).collect():
            floor[r["item"]] = r["least"]
        rest = index.join(F.broadcast(seeds), "block", "left").select(columns).mapInArrow(wave(floor), out_schema)
        best = _best(first.drop("rank").union(rest), k)
        names = spark.createDataFrame([(n, r["item_id"]) for n, r in enumerate(batch)], T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", id_type)]))
        found = found.union(best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score"))
    return found


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents of the highest scores above 0, ties by ascending doc_id.

    Null texts and texts without a term match nothing and are found by nothing. Each row of ``docs`` is a document, so rows that repeat a doc_id
    rank each; null doc_ids come last among ties. Items that repeat an item_id and text are one; of one item_id with several
    texts, each text has ranks of its own. Texts of any length are read whole. Empty tables give none. Other columns are not looked at.
    """
    return ranked_in(indexed(docs), items, docs.schema["doc_id"].dataType, k)
