"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

The lengths of pieces are integers up to the capacity, so a plan needs the number of pieces of each
length only: at most ``capacity`` counts, whatever the corpus. Large pieces, above a third of the
capacity, are matched greedily, the largest with the largest that still fits, so a bin holds two of
them at most. Smaller ones, the longest first, go where they leave the smallest gap. Bins that are
filled alike are planned once and counted. Pieces then find their place by rank within their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.arrow import bounded_batches, plain_names
from tidewell.llm.tokens import encoded_slices
from tidewell.session import written

#: Ranks within a length are counted in so many parts, so that a length that a third of the pieces have is spread.
RANK_PARTS = 256


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, separator: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the separator, cut only if longer than ``capacity``.

    The first piece of a cut document holds the rest; all others are full. A null text is the
    separator alone. Repeated rows give repeated pieces.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.array([separator], np.uint32)
        for rows, parts, at in encoded_slices(batches, tokenizer_path):
            ids = np.concatenate([gathered(starts, counts, of) for of, starts, counts in parts])
            ends = np.append(0, np.cumsum(np.concatenate([counts for _, _, counts in parts])))[at]
            texts = [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            out: list[tuple[int, int, int, int, int]] = []
            for row, ids in enumerate(texts):
                ids = np.concatenate([ids, last])
                raw, n = memoryview(ids.astype("<u4")).cast("B"), len(ids)
                first = n if n <= capacity else (n - 1) % capacity + 1
                edges = [0, *range(first, n + 1, capacity)]
                out += [(row, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
            cols = [np.array(c, np.int64) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").take(pa.array(cols[0])), pa.array(cols[1].astype(np.int32)), *map(pa.array, cols[2:])],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def gathered(starts: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values[start : start + length] of all spans, one after the other."""
    before = np.cumsum(lengths) - lengths
    return values[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]


def packing_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first_rank, bins, each, first_bin, offset): ranks from first_rank on, ``each`` in every of ``bins`` bins.

    At most two bins' kinds arise for each length and step, so the plan's size depends on the capacity alone.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used: dict[int, int] = dict.fromkeys(left, 0)
    slots: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of bins (first, number)
    open_gaps: list[int] = []
    bins = 0

    def open_with(gap: int, first: int, number: int) -> None:
        if number and gap:
            if gap not in gaps:
                gaps[gap] = []
                insort(open_gaps, gap)
            gaps[gap].append((first, number))

    def place(length: int, first: int, number: int, each: int, offset: int) -> None:
        slots.append((length, used[length], number, each, first, offset))
        used[length] += number * each
        left[length] -= number * each

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        x = large[-1]
        k = bisect_left(large, capacity - x + 1) - 1
        y = large[k] if k >= 0 else 0
        number = left[x] if not y else left[x] // 2 if x == y else min(left[x], left[y])
        if x == y and left[x] == 1:  # alone: the next smaller one, if any
            y = large[k - 1] if k > 0 else 0
            number = 1
        place(x, bins, number, 1, 0)
        if y:
            place(y, bins, number, 1, x)
        open_with(capacity - x - y, bins, number)
        bins += number
        large = [n for n in large if left[n]]
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        k = bisect_left(open_gaps, length)
        later: list[tuple[int, int, int]] = []
        while left[length] and k < len(open_gaps):
            gap = open_gaps.pop(k)
            fit = gap // length
            for first, number in gaps.pop(gap):
                full = min(number, left[length] // fit)
                if full:
                    place(length, first, full, fit, capacity - gap)
                    later.append((gap - fit * length, first, full))
                rest = left[length] if full < number else 0
                if rest:
                    place(length, first + full, 1, rest, capacity - gap)
                    later.append((gap - rest * length, first + full, 1))
                done = full + bool(rest)
                if done < number:
                    later.append((gap, first + done, number - done))
        for run in later:
            open_with(*run)
        if n := left[length]:
            fit = capacity // length
            for number, each in ((n // fit, fit), (1 if n % fit else 0, n % fit)):
                if number:
                    place(length, bins, number, each, 0)
                    open_with(capacity - each * length, bins, number)
                    bins += number
    return slots


def packed(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` with sequence_id and offset. Pieces of any length up to ``capacity``; no column of the input is lost, whatever its name.

    An empty table gives an empty one. Pieces that are alike in all columns take places of their own.
    """
    names, n = pieces.columns, pieces.count()
    columns = plain_names(pieces, ("doc_id", "piece", "length"))
    pieces = pieces.toDF(*columns)
    parts = max(RANK_PARTS, n // 1_000_000)
    keyed = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    counts = keyed.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most ``capacity`` rows
    plan = np.array(sorted(packing_plan(by_length, capacity)), np.int64).reshape(-1, 6)
    keys = (plan[:, 0] << 44) + plan[:, 1]
    within = F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece"))
    ranked = keyed.withColumn("_rank", within - 1).join(starts, ["length", "_part"])
    ranked = ranked.select(*columns, (F.col("_rank") + F.col("_before")).alias("_rank"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            length, rank = (rows.column(c).to_numpy().astype(np.int64) for c in ("length", "_rank"))
            slot = plan[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            rank = rank - slot[:, 1]
            sequence, offset = slot[:, 4] + rank // slot[:, 3], slot[:, 5] + rank % slot[:, 3] * length
            rows = rows.select(columns)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(placed, f"{schema}, sequence_id long, offset long").toDF(*names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """Every piece of every document with its sequence and its place there. Tokens are counted once and kept as a table of pieces."""
    return packed(written(token_pieces(docs, tokenizer_path, capacity), "pieces"), capacity)
