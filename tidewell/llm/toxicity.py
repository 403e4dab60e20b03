"""Toxicity: subword-bag embeddings averaged into a linear softmax.

Words are known by their byte n-grams and as wholes, hashed to buckets, so that an unseen misspelling shares
most of its vectors with the word it bends. Bags are a window of a few words, one from each word on, and the whole text. Embeddings and
softmax are trained jointly in numpy on a bounded sample of labelled rows; of a text the window that scores highest so far is learned
from, and a random one of a clean text. A text's score comes from its worst window, so that a long text hides nothing, from its whole
bag, and from how many windows it has, as the worst of many is worse by chance; the share of each is fitted on rows kept apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.arrow import bounded_batches, free_name, lowered, mixed, plain_names, released, span_hashes, span_values, text_slices, word_spans
from tidewell.llm.decontaminate import IS_WORD
from tidewell.llm.packing import gathered
from tidewell.llm.tokens import edges_and_data

#: The sample: so many rows of each label at most, the first by hash of doc_id.
TRAIN_TOXIC, TRAIN_CLEAN = 3000, 6000
#: Of a longer text so many parts of so many characters are in the sample, the first by hash of doc_id and place.
TEXT_PARTS, PART_CHARS = 2, 1 << 16
BUCKETS, DIMENSIONS = 1 << 18, 12
#: Words of a window; lengths of n-grams.
WINDOW, GRAMS = 2, (3, 4, 5)
#: Passes over the sample at least, and steps at least: a small sample is passed over more often.
EPOCHS, STEPS, BATCH, RATE = 8, 600, 256, 0.3
#: One row of so many of the sample is not trained on: on those the logits are calibrated.
CALIBRATED_ON = 5
#: What holds the shares of the whole bag and of the number of windows near 0.
RIDGE = 1.0
WORDS_AT_ONCE, WINDOWS_AT_ONCE = 50_000, 1 << 18
#: Bytes of the sample's texts that are cut into words at once, and texts whose words are counted at once.
PART_BYTES, TEXTS_AT_ONCE = 2 << 20, 500


def subwords(words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of each word's buckets, and the buckets: n-grams of ``<word>`` and the word."""
    parts = [_subwords(words.slice(k, WORDS_AT_ONCE)) for k in range(0, len(words), WORDS_AT_ONCE)]
    counts = np.concatenate([np.zeros(0, np.int64), *(c for c, _ in parts)])
    return np.append(0, np.cumsum(counts)).astype(np.int64), np.concatenate([np.zeros(0, np.int32), *(b for _, b in parts)])


def _subwords(words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    edges, data = edges_and_data(words)
    data = data[: edges[-1]]
    n = len(words)
    padded = np.zeros(len(data) + 2 * n, np.uint8)
    heads = edges[:-1] + 2 * np.arange(n)
    inner = np.ones(len(padded), bool)
    inner[heads] = inner[edges[1:] + 2 * np.arange(n) + 1] = False
    padded[inner] = data[: edges[-1]]
    padded[heads] = ord("<")
    padded[edges[1:] + 2 * np.arange(n) + 1] = ord(">")
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(edges) + 2)
    owners, buckets = [np.arange(n, dtype=np.int32)], [span_hashes(data, edges[:-1], edges[1:])]
    for k in GRAMS:
        if len(padded) < k:
            continue
        h = np.zeros(len(padded) - k + 1, np.uint64)
        for j in range(k):
            h = h * np.uint64(257) + padded[j : len(padded) - k + 1 + j].astype(np.uint64)
        same = owner[: len(h)] == owner[k - 1 :]
        owners.append(owner[: len(h)][same])
        buckets.append(mixed(h[same] * np.uint64(8) + np.uint64(k)))
    owner, bucket = np.concatenate(owners), (np.concatenate(buckets) >> np.uint64(40)).astype(np.int32) % BUCKETS
    order = np.argsort(owner, kind="stable")
    return np.bincount(owner, minlength=n), bucket[order]


class Windows:
    """Words of a slice of texts, coded, and the windows they make."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, split: bool = True):
        low = lowered(data)
        starts, ends, word_at = word_spans(IS_WORD[low], offsets)
        coded = span_values(low, starts, ends).dictionary_encode()
        self.words, self.code = coded.dictionary, coded.indices.to_numpy()
        if split:
            self.edges, self.buckets = subwords(self.words)
        n_words = np.diff(word_at)
        n_windows = np.where(n_words > 0, np.maximum(n_words - WINDOW + 1, 1), 0)
        self.text_at = np.append(0, np.cumsum(n_windows))  # edges of texts, in windows
        within = np.arange(self.text_at[-1]) - np.repeat(self.text_at[:-1], n_windows)
        self.first = (np.repeat(word_at[:-1], n_windows) + within).astype(np.int32)  # first word of each window
        self.last = np.minimum(self.first + WINDOW, np.repeat(word_at[1:], n_windows)).astype(np.int32)

    @classmethod
    def of(cls, texts: list[str]) -> Windows:
        """Of texts of any number, cut in parts."""
        ends = np.cumsum([len(t) for t in texts]) // PART_BYTES
        edges = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
        parts = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            raw = [t.encode() for t in texts[a:b]]
            parts.append(cls(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64), split=False))
        coded = pa.chunked_array([p.words for p in parts]).combine_chunks().dictionary_encode()
        place = np.split(coded.indices.to_numpy(), np.cumsum([len(p.words) for p in parts])[:-1])
        n_words, n_windows = (np.append(0, np.cumsum([len(x) for x in xs])) for xs in ([p.code for p in parts], [p.first for p in parts]))
        out = cls.__new__(cls)
        out.words, out.code = coded.dictionary, np.concatenate([at[p.code] for at, p in zip(place, parts, strict=True)])
        out.edges, out.buckets = subwords(out.words)
        out.text_at = np.concatenate([[0], *(p.text_at[1:] + n for p, n in zip(parts, n_windows, strict=False))])
        out.first, out.last = (np.concatenate([getattr(p, side) + np.int32(n) for p, n in zip(parts, n_words, strict=False)]) for side in ("first", "last"))
        return out

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """The sum of ``weights`` over the buckets of each word."""
        out = np.empty(len(self.edges) - 1, np.float32)
        for k in range(0, len(out), WORDS_AT_ONCE):
            edges = self.edges[k : k + WORDS_AT_ONCE + 1]
            out[k : k + WORDS_AT_ONCE] = np.add.reduceat(weights[self.buckets[edges[0] : edges[-1]]], edges[:-1] - edges[0])
        return out

    def logits(self, weights: np.ndarray) -> np.ndarray:
        """The mean of ``weights`` over the buckets of each window."""
        if not len(self.first):
            return np.zeros(0)
        counts, sums = np.diff(self.edges).astype(np.float32), self.sums(weights)
        out = np.empty(len(self.first), np.float32)
        for k in range(0, len(out), WINDOWS_AT_ONCE):
            first, last = self.first[k : k + WINDOWS_AT_ONCE], self.last[k : k + WINDOWS_AT_ONCE]
            total, size = sums[self.code[first]], counts[self.code[first]]
            for j in range(1, WINDOW):
                has = np.flatnonzero(first + j < last)
                word = self.code[first[has] + j]
                total[has] += sums[word]
                size[has] += counts[word]
            out[k : k + WINDOWS_AT_ONCE] = total / size
        return out

    def whole(self, weights: np.ndarray) -> np.ndarray:
        """The mean of ``weights`` over the buckets of each text, 0 where it has no words."""
        edges = np.append(self.first, len(self.code))[self.text_at]
        out, some = np.zeros(len(edges) - 1), np.diff(edges) > 0
        if some.any():
            counts, sums = np.diff(self.edges), self.sums(weights)
            out[some] = np.add.reduceat(sums[self.code].astype(np.float64), edges[:-1][some]) / np.add.reduceat(counts[self.code], edges[:-1][some])
        return out

    def best(self, logits: np.ndarray, empty: float) -> np.ndarray:
        """The highest logit of each text, ``empty`` where it has no words."""
        out = np.full(len(self.text_at) - 1, empty)
        some = np.diff(self.text_at) > 0
        if some.any():
            out[some] = np.maximum.reduceat(logits, self.text_at[:-1][some])
        return out

    def bags(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the windows ``which``, and where each one's begin."""
        words = self.code[gathered(self.first[which], self.last[which] - self.first[which], np.arange(len(self.code)))]
        sizes = np.diff(self.edges)[words]
        ends = np.append(0, np.cumsum(sizes))
        per = self.last[which] - self.first[which]
        return gathered(self.edges[words], sizes, self.buckets), ends[np.cumsum(per) - per]


class Model:
    """Weights of buckets, and what a text's worst window, whole bag and number of windows, and a constant, add to its logit."""

    def __init__(self, weights: np.ndarray, shares: np.ndarray, longest: float = np.inf):
        self.weights, self.shares, self.longest = weights, shares, longest

    def measures(self, windows: Windows) -> np.ndarray:
        """A row for each text; without words all but the constant are 0. More windows than any text had that was fitted on count as that many."""
        size = np.minimum(np.log1p(np.diff(windows.text_at)), self.longest)
        return np.stack([windows.best(windows.logits(self.weights), 0.0), windows.whole(self.weights), size, np.ones(len(size))], 1)

    def logits(self, windows: Windows) -> np.ndarray:
        return self.measures(windows) @ self.shares


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Weights of buckets are the difference of the softmax's two logits, which is linear in the buckets of a bag."""
    y = np.array(labels, bool)
    if not y.any() or y.all():  # nothing to tell apart: the share of toxic rows
        share = (y.sum() + 1) / (len(y) + 20)
        return Model(np.zeros(BUCKETS, np.float32), np.array([0, 0, 0, np.log(share / (1 - share))]))
    within = np.empty(len(y), np.int64)  # place of a row among those of its label
    for label in (True, False):
        within[y == label] = np.arange((y == label).sum())
    apart = within % CALIBRATED_ON == CALIBRATED_ON - 1
    if not (apart & y).any() or not (apart & ~y).any():
        weights, bias = _fitted(Windows.of(texts), y, seed)
        return Model(weights, np.array([1, 0, 0, bias]))
    weights, bias = _fitted(Windows.of([t for t, out in zip(texts, apart, strict=True) if not out]), y[~apart], seed)
    model = Model(weights, np.array([1, 0, 0, bias]))
    measures = model.measures(Windows.of([t for t, out in zip(texts, apart, strict=True) if out]))
    return Model(weights, _calibrated(measures, y[apart], model.shares), float(measures[:, 2].max()))


def _calibrated(measures: np.ndarray, y: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    """Shares by logistic regression, towards labels that stop short of 0 and 1 by what a row more would change."""
    spread = np.append(np.maximum(measures[:, :-1].std(0), 1e-6), 1)
    x = measures / spread
    goal = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    ridge = RIDGE * np.diag([0, 1, 1, 0])
    beta = np.zeros(x.shape[1])
    loss = lambda b: np.logaddexp(0, x @ b).sum() - goal @ (x @ b) + b @ ridge @ b / 2
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ beta)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-6 * np.eye(len(beta)), x.T @ (goal - p) - ridge @ beta)
        while np.abs(step).max() > 1e-9 and loss(beta + step) > loss(beta):
            step /= 2
        beta += step
    return beta / spread if beta[0] > 0 else otherwise


def _fitted(windows: Windows, y: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    rng = np.random.default_rng(seed)
    some = np.flatnonzero(np.diff(windows.text_at) > 0)
    weights = _first_guess(windows, y)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    softmax, bias = rng.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32)
    grown = [np.full(BUCKETS, 1e-6, np.float32), np.full(softmax.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32)]
    per_epoch = -(-(len(some) + int((~y[some]).sum())) // BATCH)
    for _ in range(max(EPOCHS, -(-STEPS // max(1, per_epoch)))):
        logits = windows.logits(weights)
        top = np.array([windows.text_at[t] + np.argmax(logits[windows.text_at[t] : windows.text_at[t + 1]]) for t in some])
        clean = some[~y[some]]
        other = windows.text_at[clean] + (rng.random(len(clean)) * (windows.text_at[clean + 1] - windows.text_at[clean])).astype(np.int64)
        chosen, toxic = np.concatenate([top, other]), np.concatenate([y[some], np.zeros(len(other), bool)])
        order = rng.permutation(len(chosen))
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            buckets, at = windows.bags(chosen[part])
            size = np.diff(np.append(at, len(buckets))).astype(np.float32)[:, None]
            mean = np.add.reduceat(vectors[buckets], at) / size
            z = mean @ softmax + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), toxic[part].astype(int)] -= 1
            gradients = [mean.T @ p / len(part), p.mean(0)]
            to_mean = np.repeat(p @ softmax.T / size, size[:, 0].astype(int), axis=0)
            touched, at_bucket = np.unique(buckets, return_inverse=True)
            moved = np.stack([np.bincount(at_bucket, to_mean[:, d], len(touched)) for d in range(DIMENSIONS)], 1).astype(np.float32)
            grown[0][touched] += (moved**2).mean(1)
            vectors[touched] -= RATE * moved / np.sqrt(grown[0][touched])[:, None]
            for value, gradient, past in ((softmax, gradients[0], grown[1]), (bias, gradients[1], grown[2])):
                past += gradient**2
                value -= RATE * gradient / np.sqrt(past)
        weights = vectors @ (softmax[:, 1] - softmax[:, 0])
    return weights.astype(np.float32), float(bias[1] - bias[0])


def _first_guess(windows: Windows, y: np.ndarray) -> np.ndarray:
    """Log odds of each bucket over the texts, by which the first windows to learn from are chosen."""
    by_word = np.zeros((2, len(windows.words)), np.int64)
    word_at = np.append(windows.first, len(windows.code))[windows.text_at]
    for k in range(0, len(y), TEXTS_AT_ONCE):
        edges = word_at[k : k + TEXTS_AT_ONCE + 1]
        of = np.repeat(np.arange(k, k + len(edges) - 1), np.diff(edges))
        pairs = np.unique(of * len(windows.words) + windows.code[edges[0] : edges[-1]])
        for label in (0, 1):
            by_word[label] += np.bincount(pairs[y[pairs // len(windows.words)] == label] % len(windows.words), minlength=len(windows.words))
    seen = np.zeros((2, BUCKETS))
    for k in range(0, len(windows.words), WORDS_AT_ONCE):
        edges = windows.edges[k : k + WORDS_AT_ONCE + 1]
        owner = np.repeat(np.arange(k, k + len(edges) - 1), np.diff(edges))
        for label in (1, 0):
            seen[1 - label] += np.bincount(windows.buckets[edges[0] : edges[-1]], by_word[label][owner], BUCKETS) / max(1, (y == label).sum())
    least = 2 / len(y)
    return np.log((seen[0] + least) / (seen[1] + least))


def model_of(docs: DataFrame, labels: DataFrame) -> Model:
    """Trained on ``labels`` (doc_id, toxic); rows with a null in either and labels without a text are left out.

    Of labels that differ for one doc_id the toxic one counts; rows that repeat a doc_id are learned from each. Null texts are empty.
    """
    bounded_batches(docs.sparkSession)
    marked = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [marked.filter(f"toxic {sign} 0").orderBy(*order).limit(n) for sign, n in (("<>", TRAIN_TOXIC), ("=", TRAIN_CLEAN))]
    sample = F.broadcast(parts[0].unionByName(parts[1]).withColumnsRenamed({"doc_id": "_id", "toxic": "_toxic"}))  # a bounded number of rows
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(sample, F.col("doc_id") == F.col("_id"))
    places = F.sequence(F.lit(0), F.ceil(F.length("text") / PART_CHARS).cast("int") - 1)
    chosen = F.slice(F.array_sort(F.transform(places, lambda k: F.struct(F.xxhash64("doc_id", k), k.alias("k")))), 1, TEXT_PARTS)
    cut = F.array_join(F.transform(F.array_sort(chosen["k"]), lambda k: F.substring("text", k * PART_CHARS + 1, F.lit(PART_CHARS))), " ")
    rows = rows.select("doc_id", F.when(F.length("text") <= TEXT_PARTS * PART_CHARS, F.col("text")).otherwise(cut).alias("text"), "_toxic")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        model = train([t for _, t, _ in rows], [y for _, _, y in rows])
        released()
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (model.weights, model.shares)] + [pa.array([model.longest])], ["weights", "shares", "longest"])

    fitted = rows.repartition(1).mapInArrow(fit, "weights binary, shares binary, longest double").collect()  # one row: the sample is bounded
    if not fitted:
        return train([], [])
    return Model(np.frombuffer(fitted[0]["weights"], np.float32), np.frombuffer(fitted[0]["shares"]), fitted[0]["longest"])


def scored(docs: DataFrame, model: Model) -> tuple[DataFrame, str]:
    """``docs`` with a column of scores, 0 to 1, and its name, ``_toxicity`` if that is free.

    Null and empty texts score as texts without a sign of either label; repeated rows and equal texts score alike, whatever their length or the
    rows around them. An empty table gives an empty one; columns of any name are kept.
    """
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    columns, name = plain_names(docs), free_name(docs.columns, "_toxicity")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches):
            z = held.value.logits(Windows(data, offsets))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(1 / (1 + np.exp(-z)))], [*columns, "score"])

    plain = docs.toDF(*columns)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(score, f"{schema}, score double").toDF(*docs.columns, name), name


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether a row is held out by crc32 of its doc_id as text; rows without one are not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def without_toxic(docs: DataFrame, labels: DataFrame, score: float = 0.3) -> DataFrame:
    """``docs`` without the rows that score ``score`` or more; learned from ``labels`` but for those of every fourth doc_id by hash.

    Rows that repeat a text stay or go together; a score of ``score`` itself goes. Without labels all rows score alike. See ``scored``.
    """
    found, name = scored(docs, model_of(docs, labels.filter(~held_out(F.col("doc_id"), 4, 2))))
    return found.filter(F.col(name) < score).drop(name)
