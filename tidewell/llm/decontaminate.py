"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

Documents are streamed through the automaton, which tracks the longest match that ends at each word.
Where it reaches the window, the window's words are hit. Only stretches whose neighbouring word pairs all
occur in some item are streamed: no match can lie elsewhere.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.arrow import bounded_batches, free_name, lowered, mixed, plain_names, quoted, span_hashes, text_slices, word_spans
from tidewell.session import written

#: Text of items that one automaton holds; more items take more automata, and a pass over the stretches for each.
ROUND_BYTES = 1 << 20
#: Slots, at most two to this power, of a table of neighbouring words, which is broadcast: 64 MB.
PAIR_BITS = 26

#: What takes the place of a span: a word of a character that texts don't have (U+FFFC, the object replacement character).
SEAM = " \ufffc ".encode()

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: digits, a-z, and all that is not ASCII."""
    return WORD.findall((text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))


class Neighbours:
    """A table of the pairs of words that stand side by side in some item: where a document's don't, no match can lie."""

    def __init__(self, bits: int, least: int):
        self.pairs, self.single, self.least = np.zeros(1 << bits, bool), np.zeros(0, np.uint64), least

    def pair_slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (mixed(a * np.uint64(3) + b) >> np.uint64(65 - len(self.pairs).bit_length())).astype(np.int64)

    def add(self, hashes: np.ndarray, word_at: np.ndarray, window: int) -> None:
        """Takes in items by the hashes of their words. word_at: the edges of items."""
        inner = np.ones(max(0, len(hashes) - 1), bool)
        inner[word_at[(word_at > 0) & (word_at < len(hashes))] - 1] = False
        self.pairs[self.pair_slots(hashes[:-1][inner], hashes[1:][inner])] = True
        counts = np.diff(word_at)
        self.single = np.union1d(self.single, hashes[word_at[:-1][counts == 1]])
        self.least = min([self.least, window, *counts[counts > 0].tolist()])

    def stretches(self, hashes: np.ndarray, word_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends, in words, of all stretches in which a match can lie. word_at: the edges of texts."""
        near = np.zeros(len(hashes) + 1, bool)
        if len(hashes) > 1:
            near[1:-1] = self.pairs[self.pair_slots(hashes[:-1], hashes[1:])]
        near[word_at] = False
        edges = np.diff(near.astype(np.int8), prepend=0)
        starts, ends = np.flatnonzero(edges == 1) - 1, np.flatnonzero(edges == -1)
        long = ends - starts >= self.least
        starts, ends = starts[long], ends[long]
        if len(self.single):  # one-word items: every word alone
            lone = np.flatnonzero(np.isin(hashes, self.single))
            starts, ends = np.concatenate([starts, lone]), np.concatenate([ends, lone + 1])
        return starts, ends


class Automaton(Neighbours):
    """Of all items' words; states of windows know the items in which they occur."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.short: dict[tuple[bytes, ...], set[str]] = {}
        self.items_at: dict[int, set[str]] = {}
        ends: list[tuple[int, str]] = []
        pairs: set[tuple[bytes, bytes]] = set()
        single: set[bytes] = set()
        for item, words in items:
            if not words:
                continue
            if len(words) < window:
                self.short.setdefault(tuple(words), set()).add(item)
            if len(words) == 1:
                single.update(words)
            pairs.update(zip(words[:-1], words[1:], strict=True))
            last = 0
            for k, w in enumerate(words):
                last = self._extend(last, w)
                if k + 1 >= window:
                    ends.append((last, item))
        for state, item in ends:
            self.items_at.setdefault(self.anchor(state), set()).add(item)
        self.shorts = sorted({len(t) for t in self.short})
        self.least = min([window, *self.shorts])
        self.single = np.sort(hashes_of(sorted(single)))
        self.pairs = np.zeros(1 << max(16, (64 * len(pairs)).bit_length()), bool)
        if pairs:
            a, b = (hashes_of([p[i] for p in sorted(pairs)]) for i in (0, 1))
            self.pairs[self.pair_slots(a, b)] = True

    def _extend(self, last: int, w: bytes) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: bytes, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def anchor(self, state: int) -> int:
        """The state of the last ``window`` words of a longer match."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, set[str]]]:
        """Spans [start, end) of words that are a window of the items, and those items."""
        state = matched = 0
        for end, w in enumerate(words, 1):
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                matched += 1
            if matched >= self.window:
                yield end - self.window, end, self.items_at[self.anchor(state)]
            for n in self.shorts:
                if matched >= n and (items := self.short.get(tuple(words[end - n : end]))):
                    yield end - n, end, items


def hashes_of(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return span_hashes(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if words else np.zeros(0, np.uint64)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


#: The columns that ``matched`` adds, with their types.
_FOUND = {"_tw_words": "long", "_tw_spans": "array<struct<a:long,b:long>>", "_tw_items": "array<string>"}


def _pass(docs: DataFrame, automaton: Automaton) -> DataFrame:
    """One pass where all items are in one automaton."""
    held = docs.sparkSession.sparkContext.broadcast(automaton)
    columns = docs.columns

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = held.value
        for rows, data, offsets in text_slices(batches):
            data = lowered(data)
            starts, ends, word_at = word_spans(IS_WORD[data], offsets)
            spans: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[str]] = {}
            for a, b in zip(*automaton.stretches(span_hashes(data, starts, ends), word_at), strict=True):
                words = [data[i:j].tobytes() for i, j in zip(starts[a:b], ends[a:b], strict=True)]
                row = int(np.searchsorted(word_at, a, "right")) - 1
                for i, j, which in automaton.matches(words):
                    first = int(a - word_at[row])
                    spans.setdefault(row, []).append((first + i, first + j))
                    items.setdefault(row, set()).update(which)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.diff(word_at)), *_lists(spans, items, rows.num_rows)], [*columns, *_FOUND])

    schema = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in columns]
    return docs.mapInArrow(stream, ", ".join([*schema, *(f"{k} {v}" for k, v in _FOUND.items())]))


def _lists(spans: dict[int, list[tuple[int, int]]], items: dict[int, set[str]], n: int) -> tuple[pa.Array, pa.Array]:
    """Merged spans and sorted items of rows 0 to n; those without one have empty lists, at no cost."""
    pair = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    if not spans:
        empty = pa.array(np.zeros(n + 1, np.int32))
        return pa.ListArray.from_arrays(empty, pa.array([], pair.value_type)), pa.ListArray.from_arrays(empty, pa.array([], pa.string()))
    every = [[{"a": a, "b": b} for a, b in merged(spans[k])] if k in spans else [] for k in range(n)]
    return pa.array(every, pair), pa.array([sorted(items.get(k, ())) for k in range(n)], pa.list_(pa.string()))


def _in_stretches(docs: DataFrame, rounds: Iterable[list[tuple[str, str]]], near: Neighbours, window: int) -> DataFrame:
    """Where items take several automata: documents are read once, for the stretches in which a match can lie; each automaton reads those alone."""
    held = docs.sparkSession.sparkContext.broadcast(near)
    columns = docs.columns
    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in columns)

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches):
            data = lowered(data)
            starts, ends, word_at = word_spans(IS_WORD[data], offsets)
            found: list[list[dict]] = [[] for _ in range(rows.num_rows)]
            for a, b in zip(*(x.tolist() for x in held.value.stretches(span_hashes(data, starts, ends), word_at)), strict=True):
                row = int(np.searchsorted(word_at, a, "right")) - 1
                found[row].append({"first": a - int(word_at[row]), "words": b" ".join(data[i:j].tobytes() for i, j in zip(starts[a:b], ends[a:b], strict=True))})
            kind = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.binary())]))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.diff(word_at)), pa.array(found, kind)], [*columns, "_tw_row", "_tw_words", "_tw_at"])

    numbered = docs.withColumn("_tw_row", F.monotonically_increasing_id())
    read = written(numbered.mapInArrow(stretch, f"{schema}, _tw_row long, _tw_words long, _tw_at array<struct<first:long,words:binary>>"), "stretches")
    parts = read.select("_tw_row", F.explode("_tw_at").alias("s")).select("_tw_row", "s.first", "s.words")
    parts = written(parts.repartition("_tw_row", "first"), "stretch-parts")
    hits = "_tw_row long, spans array<struct<a:long,b:long>>, items array<string>"
    found = docs.sparkSession.createDataFrame([], hits)
    for part in rounds:
        automaton = docs.sparkSession.sparkContext.broadcast(Automaton(sorted({(i, tuple(words_of(t))) for i, t in part}), window))

        def stream(batches: Iterator[pa.RecordBatch], automaton=automaton) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spans, items = {}, {}
                for k, (first, words) in enumerate(zip(batch.column("first").to_pylist(), batch.column("words").to_pylist(), strict=True)):
                    for i, j, which in automaton.value.matches(words.split(b" ")):
                        spans.setdefault(k, []).append((first + i, first + j))
                        items.setdefault(k, set()).update(which)
                hit = sorted(spans)
                lists = _lists(dict(enumerate(spans[k] for k in hit)), dict(enumerate(items[k] for k in hit)), len(hit))
                yield pa.RecordBatch.from_arrays([batch.column("_tw_row").take(pa.array(hit, pa.int64())), *lists], ["_tw_row", "spans", "items"])

        found = found.union(written(parts.mapInArrow(stream, hits), "stretch-hits"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, items = (dict(enumerate(batch.column(c).to_pylist())) for c in ("spans", "items"))
            lists = _lists({k: [(s["a"], s["b"]) for s in v] for k, v in spans.items()}, {k: set(v) for k, v in items.items()}, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("_tw_row"), *lists], ["_tw_of", "_tw_spans", "_tw_items"])

    hit = found.groupBy("_tw_row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    hit = hit.mapInArrow(join, "_tw_of long, _tw_spans array<struct<a:long,b:long>>, _tw_items array<string>")
    empty = {"_tw_spans": F.array().cast(_FOUND["_tw_spans"]), "_tw_items": F.array().cast(_FOUND["_tw_items"])}
    clean = read.filter(F.size("_tw_at") == 0).withColumns(empty)
    dirty = read.filter(F.size("_tw_at") > 0).join(hit, F.col("_tw_row") == F.col("_tw_of"), "left").withColumns({k: F.coalesce(k, v) for k, v in empty.items()})
    return clean.select(*columns, *_FOUND).unionByName(dirty.select(*columns, *_FOUND))


def matched(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> tuple[DataFrame, list[str]]:
    """``docs`` with the number of words, the merged spans of hit words and the items of which a window occurs, and the names of these columns.

    A window is ``window`` words of an item in a row, or a shorter item as a whole. Null and empty texts have no
    words and no hits; null, empty and repeated items are fine. Repeated rows are judged alike.
    A null item_id counts as an item named by the empty string. The benchmark is collected by parts of ROUND_BYTES, each for an automaton of its own;
    documents are read once, whatever the number of parts.
    """
    bounded_batches(docs.sparkSession)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds = max(1, math.ceil(size / ROUND_BYTES))
    plain, names = docs.toDF(*plain_names(docs)), [free_name(docs.columns, n) for n in _FOUND]
    part = lambda k: [(r["item_id"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == k).collect()]
    if rounds == 1:
        found = _pass(plain, Automaton(sorted({(i, tuple(words_of(t))) for i, t in part(0)}), window))
    else:
        near = Neighbours(min(PAIR_BITS, max(16, (16 * size).bit_length())), window)
        for k in range(rounds):
            raw = [t.encode() for _, t in part(k)]
            data = lowered(np.frombuffer(b"".join(raw), np.uint8))
            starts, ends, word_at = word_spans(IS_WORD[data], np.append(0, np.cumsum([len(t) for t in raw])).astype(np.int64))
            near.add(span_hashes(data, starts, ends), word_at, window)
        found = _in_stretches(plain, map(part, range(rounds)), near, window)
    return found.toDF(*docs.columns, *names), names


def _n_hit(spans: str) -> Column:
    return F.aggregate(F.col(quoted(spans)), F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row; see ``matched``.

    Texts of any length are streamed word by word. An empty table gives an empty one, an empty benchmark hits nothing. Other columns are left out.
    """
    found, (words, spans, items) = matched(docs.select("doc_id", "text"), benchmark, window)
    hit = _n_hit(spans)
    return found.select(
        "doc_id",
        F.col(words).alias("n_words"),
        hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` without the hit spans of their texts, and without documents of whose words more than ``max_coverage`` are hit.

    Rows without a hit, null and empty texts among them, stay as they are; repeated rows are treated alike. An n_chars column follows the text.
    In place of a span stands SEAM, a word of a character that texts don't have, so that what stood on both sides makes no new window.
    An empty table gives an empty one; columns of any name are kept.
    """
    found, names = matched(docs, benchmark, window)
    spans = F.col(quoted(names[1]))
    found = found.filter(_n_hit(names[1]) <= max_coverage * F.col(quoted(names[0])))

    @F.pandas_udf("string")
    def without(texts, spans):
        return texts.combine(spans, lambda t, s: t if t is None or not len(s) else cut(t, [(x["a"], x["b"]) for x in s]))

    dirty = F.size(spans) > 0
    out = found.withColumn("text", F.when(dirty, without(F.when(dirty, F.col("text")), F.when(dirty, spans))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(dirty, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return out.select([F.col(quoted(c)) for c in docs.columns])


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    raw = text.encode()
    words = [m.span() for m in WORD.finditer(raw.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))]
    parts, at = [], 0
    for a, b in spans:
        parts.append(raw[at : words[a][0]])
        at = words[b - 1][1]
    return SEAM.join([*parts, raw[at:]]).decode()
