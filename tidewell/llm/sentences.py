"""Substring dedup over sliding sentence spans.

A text is cut behind every run of ``. ! ?`` and line feeds; a piece with a word is a sentence. Every run of several
consecutive sentences is hashed. Of all runs with one hash, in the order of doc_id and place, the first stays; sentences
that any other one covers are removed.

Runs of MIN_SENTENCES stand for all longer ones: a run of more that repeats is made of such runs, which repeat with it and cover the same
sentences. So each sentence costs one hash, however long the repeated passage is.

With ``min_words`` a run also needs so many words. Then the shortest such runs from each sentence on and to each sentence
are hashed, and runs are equal when their words are, wherever these are cut into sentences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.arrow import lowered, mixed, run_hashes, span_hashes, text_slices, word_spans
from tidewell.llm.decontaminate import IS_WORD
from tidewell.session import written

#: A run has at least so many sentences.
MIN_SENTENCES = 2

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


class _Texts:
    """Pieces, sentences and words of a slice of texts, as arrays over the whole slice."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = lowered(data)
        starts, ends, word_at = word_spans(IS_WORD[low], offsets)
        ending = _ENDS[data]
        is_edge = np.zeros(len(data) + 1, bool)
        is_edge[1:] = ending & ~np.append(ending[1:], False)[: len(data)]
        is_edge[offsets] = True
        self.edges = np.flatnonzero(is_edge)
        word_edges = np.searchsorted(starts, self.edges)
        has_words = np.diff(word_edges) > 0
        self.sentence = np.flatnonzero(has_words)  # the piece of each sentence
        self.first_word = np.append(word_edges[:-1][has_words], len(starts))
        self.sentence_at = np.searchsorted(self.first_word[:-1], word_at)  # edges of texts, in sentences
        self.word_at, self.hashes = word_at, span_hashes(low, starts, ends)

    def keys(self) -> np.ndarray:
        """A key of each text by its words and by the places where its sentences end."""
        place = np.arange(len(self.hashes)) - np.repeat(self.word_at[:-1], np.diff(self.word_at))
        last = np.zeros(len(self.hashes), np.uint64)
        last[self.first_word[1:] - 1] = np.uint64(0x9E3779B97F4A7C15)
        h = np.append(np.uint64(0), np.cumsum(mixed(mixed(self.hashes ^ last) + place.astype(np.uint64)), dtype=np.uint64))
        return (h[self.word_at[1:]] - h[self.word_at[:-1]]).view(np.int64)

    def runs(self, min_words: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last sentence of every run, once each, and two 64-bit hashes of its words."""
        n, words = len(self.sentence), self.hashes
        text_end = np.repeat(self.sentence_at[1:], np.diff(self.sentence_at))
        if not min_words:
            first = np.flatnonzero(np.arange(n) + MIN_SENTENCES <= text_end)
            last = first + MIN_SENTENCES - 1
            words = words.copy()
            words[self.first_word[1:] - 1] ^= np.uint64(0x5851F42D4C957F2D)  # a sentence's last word: cuts count
        else:
            enough = np.searchsorted(self.first_word, self.first_word[:-1] + min_words)
            last = np.maximum(enough - 1, np.arange(n) + MIN_SENTENCES - 1)
            ok = last < text_end
            first, last = np.flatnonzero(ok), last[ok]
            to_end = np.searchsorted(self.first_word[:-1], self.first_word[1:] - min_words, "right") - 1
            to_end = np.minimum(to_end, np.arange(n) - MIN_SENTENCES + 1)
            other = to_end >= np.repeat(self.sentence_at[:-1], np.diff(self.sentence_at))
            from_start = np.full(n, -1)
            from_start[first] = last
            other[other] = from_start[to_end[other]] != np.flatnonzero(other)
            first, last = np.append(first, to_end[other]), np.append(last, np.flatnonzero(other))
        a, b = self.first_word[first], self.first_word[last + 1]
        bits = mixed(words)
        low, high = bits & np.uint64(2**31 - 1), bits >> np.uint64(33)
        return first, last, run_hashes(low, a, b, 0).view(np.int64), run_hashes(high, a, b, 1).view(np.int64)


def sentence_runs(docs: DataFrame, min_words: int = 0) -> DataFrame:
    """doc_id, text_key, first, last, h1, h2: every run of every text, sentences counted from 0."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches):
            texts = _Texts(data, offsets)
            first, last, h1, h2 = texts.runs(min_words)
            row = np.searchsorted(texts.sentence_at, first, "right") - 1
            at = texts.sentence_at[row]
            ids = rows.column("doc_id").take(pa.array(row))
            columns = [texts.keys()[row], (first - at).astype(np.int32), (last - at).astype(np.int32), h1, h2]
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns)], ["doc_id", "text_key", "first", "last", "h1", "h2"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, text_key long, first int, last int, h1 long, h2 long")


def repeated_sentences(docs: DataFrame, min_words: int = 0) -> DataFrame:
    """doc_id, text_key and the sentences [first, last] of every run that an earlier run equals; a row for each text."""
    runs = sentence_runs(docs, min_words)
    place = F.struct("doc_id", "text_key", "first")
    firsts = runs.groupBy("h1", "h2").agg(F.min(place).alias("place"), F.count("*").alias("n")).filter("n > 1").drop("n")
    firsts = written(firsts, "first-runs")  # both sides of the join are then dealt for it alone, and Spark splits a hot run's rows
    later = runs.join(firsts, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("place")))
    return later.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def without_repeats(docs: DataFrame, min_words: int = 0) -> DataFrame:
    """``docs`` with n_sentences, n_removed and kept_text, judged by runs of MIN_SENTENCES, or by runs of ``min_words`` words.

    Null texts are empty and keep an empty text. Rows of one doc_id with the same words and the same ends of sentences are one document:
    their runs are the same runs. Other rows of one doc_id are documents of their own, in an order that their words give. Of rows without a doc_id those come first. A text without a run of several sentences keeps all of
    them, however long it is. Pieces without a word stay. An empty table gives an empty one. Other columns, of whatever name, are left out.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches):
            keys = pa.array(_Texts(data, offsets).keys())
            yield pa.RecordBatch.from_arrays([*rows.columns, keys], ["doc_id", "text", "text_key"])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches):
            texts = _Texts(data, offsets)
            gone = np.zeros(len(texts.sentence) + 1, np.int64)
            for row, spans in enumerate(rows.column("spans").to_pylist()):
                low, high = texts.sentence_at[row : row + 2]
                for s in spans or ():
                    gone[min(low + s["first"], high)] += 1
                    gone[min(low + s["last"] + 1, high)] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            piece_gone = np.zeros(len(texts.edges) - 1, bool)
            piece_gone[texts.sentence[gone]] = True
            kept_bytes = np.repeat(~piece_gone, np.diff(texts.edges))
            at = np.append(0, np.cumsum(kept_bytes))[offsets]
            kept = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data[kept_bytes]))
            counts = np.append(0, np.cumsum(gone))[texts.sentence_at]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(np.diff(texts.sentence_at)), pa.array(np.diff(counts)), kept.cast(pa.string())],
                ["doc_id", "n_sentences", "n_removed", "kept_text"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spans = repeated_sentences(rows, min_words).withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    rows = rows.mapInArrow(keyed, f"doc_id {kind}, text string, text_key long")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    joined = rows.join(spans, same, "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(remove, f"doc_id {kind}, n_sentences long, n_removed long, kept_text string")
