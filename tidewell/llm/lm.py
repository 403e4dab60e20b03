"""Language-model scores: exact unigram counts, and a hashed maximum-entropy model with a class-factored softmax.

P(word | before) = P(class | before) * P(word | class, before). A word's class is a hash of its last two bytes. The first
factor is a softmax over classes, the second one over the words of the class: each of its SLOTS - 1 most frequent words and one place for all
others. Logits begin as logs of counts; on them come weights of hashed features, learned by gradient: for the class the
word before, the classes of the two words before, and those of the second and third before (a skip); for the word
in its class the word before and, as a skip, the second before. Words that share a place share it by their counts, unknown
ones as one.

Texts are kept as coded blocks: distinct words, as 64-bit hashes, and codes of all tokens. The words of a few blocks are combined, and each
such group sends them to the tasks of their ranges of hashes; a range's task sums what all groups have and answers each of them. So
a common word is a message for each group, and a group sends only to ranges in which it has words. Gradient updates are made by tasks
on their blocks, in rounds; between rounds a feature's moves are averaged over the tasks that saw it. The number of features grows
with the tokens learned from, up to MAX_BITS.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.arrow import hash_ranges, ids_of, ids_stream, lowered, mixed, released, span_hashes, text_slices, unzipped, word_spans, zipped
from tidewell.session import written

#: Classes (a power of two: the low bits of a word's hash name it), places in a class, and features of either softmax.
CLASSES, SLOTS, TEMPLATES = 32, 64, (3, 2)
#: Buckets of a feature: two to the power of half the bits of the number of tokens learned from and one, within these bounds. The
#: upper one keeps the weights, which are broadcast, below 180 MB.
MIN_BITS, MAX_BITS = 12, 17
#: Rounds of updates, each on its share of the blocks; tokens of a batch; step size, and past gradients that a feature begins with.
ROUNDS, BATCH, RATE, PRIOR = 2, 1 << 14, 0.2, 0.25
#: Bytes of texts in a block; rows of weights that travel together, and parts in which they are summed before the last sum.
BLOCK_BYTES, PACKET, SUM_PARTS = 4 << 20, 256, 64
#: Blocks from which a task learns before its moves are averaged with those of others; blocks that ask for counts together.
TASK_BLOCKS, GROUP_BLOCKS = 8, 4
#: Words of groups that a range's task holds.
RANGE_WORDS = 1_500_000

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: The token that ends every text, in class 0; no word has its hash but by chance.
END = np.uint64(0xE2D0_0000_0000_0000)

_BLOCK = "block long, group long, rows binary, train binary, ends binary, codes binary, hashes binary, n_words long, words binary, counts binary"


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end behind each text's words, and the edges of texts in them."""
    low = lowered(data)
    starts, ends, word_at = word_spans(_IS_WORD[low], offsets)
    words = span_hashes(low, starts, ends)
    classes = span_hashes(low, np.maximum(starts, ends - 2), ends) >> np.uint64(64 - CLASSES.bit_length() + 1)
    words = (words & ~np.uint64(CLASSES - 1)) | classes
    edges = word_at + np.arange(len(word_at))
    out = np.full(edges[-1], END)
    at = np.ones(edges[-1], bool)
    at[edges[1:] - 1] = False
    out[at] = words
    return out, edges


def classes_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(CLASSES - 1)).astype(np.int64)


def coded_blocks(docs: DataFrame, train: Column) -> DataFrame:
    """Blocks of rows with their distinct words in order of hash and all codes; the last one of a group has the words of all and how often each is in rows to learn from."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, k = (TaskContext.get().partitionId() + 1) << 32, 0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        last: tuple | None = None

        def row(block: tuple, words: bool) -> pa.RecordBatch:
            every, counts = _summed(held) if words else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            numbers = [pa.array([block[0]]), pa.array([first + block[0] % (1 << 32) // GROUP_BLOCKS])]
            binary = [pa.array([b], pa.binary()) for b in (*block[1:], zipped(every), zipped(counts))]
            return pa.RecordBatch.from_arrays([*numbers, *binary[:-2], pa.array([len(every)]), *binary[-2:]], _names(_BLOCK))

        for rows, data, offsets in text_slices(batches, limit=BLOCK_BYTES):
            if last:
                yield row(last, k % GROUP_BLOCKS == 0)
            if k % GROUP_BLOCKS == 0:
                held.clear()
            tokens, ends = word_ids(data, offsets)
            learn = rows.column("train").to_numpy(zero_copy_only=False).astype(bool)
            hashes, codes = np.unique(tokens, return_inverse=True)
            held.append((hashes, np.bincount(codes[np.repeat(learn, np.diff(ends))], minlength=len(hashes))))
            last = (first + k, ids_stream(rows), *map(zipped, (learn, ends, codes.astype(np.int32), hashes)))
            k += 1
        if last:
            yield row(last, True)

    return docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train")).mapInArrow(code, _BLOCK)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of all parts in order, and the sums of their counts."""
    distinct, at = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
    return distinct, np.bincount(at, np.concatenate([c for _, c in parts]), len(distinct)).astype(np.int64)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def word_counts(blocks: DataFrame, top: int) -> DataFrame:
    """group, part, counts: the counts over all rows to learn from of a group's words in a range of hashes, in order.

    A row of group -1 for each range has the tokens and the distinct words of each class, and in ``top`` the hashes and
    counts of the range's most frequent words.
    """
    ranges = max(1, -(-(blocks.agg(F.sum("n_words")).first()[0] or 0) // RANGE_WORDS))
    schema = "group long, part long, counts binary, top binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, counts = unzipped(row["words"], np.uint64), unzipped(row["counts"], np.int64)
                parts = [(k, zipped(words[a:b]), zipped(counts[a:b])) for k, a, b in hash_ranges(words, ranges)]
                columns = [pa.array(c, t) for c, t in zip(zip(*parts, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([row["group"]] * len(parts)), *columns], ["group", "part", "words", "counts"])

    def answer(asked: pa.Table) -> pa.Table:
        parts = [(unzipped(w, np.uint64), unzipped(c, np.int64)) for w, c in zip(*(asked.column(c).to_pylist() for c in ("words", "counts")), strict=True)]
        distinct, total = _summed(parts)
        replies = [zipped(total[np.searchsorted(distinct, w)]) for w, _ in parts]
        kind = classes_of(distinct)
        stats = np.stack([np.bincount(kind, total, CLASSES), np.bincount(kind[total > 0], minlength=CLASSES)]).astype(np.int64)
        best = np.argsort(-total, kind="stable")[:top]
        frequent = np.stack([distinct[best].view(np.int64), total[best]])
        part, n = asked.column("part")[0].as_py(), len(parts)
        released()
        columns = [pa.array([*asked.column("group").to_pylist(), -1], pa.int64()), pa.array([part] * (n + 1), pa.int64())]
        return pa.table([*columns, pa.array([*replies, zipped(stats)], pa.binary()), pa.array([None] * n + [zipped(frequent)], pa.binary())], names=_names(schema))

    asked = blocks.filter("n_words > 0").select("group", "words", "counts").mapInArrow(ask, "group long, part long, words binary, counts binary")
    return asked.groupBy("part").applyInArrow(answer, schema)


class Model:
    """Weights of both softmaxes, a row for each bucket of each feature and below them the biases, and what the counts give."""

    def __init__(self, totals: np.ndarray, distinct: np.ndarray, frequent: list[tuple[int, int]], size: int = SLOTS):
        """totals, distinct: tokens and words of each class; frequent: (hash, count) of the most frequent words, in that order."""
        self.size, self.n, self.v = size, int(totals.sum()), int(distinct.sum())
        bits = min(MAX_BITS, max(MIN_BITS, self.n.bit_length() // 2 + 1))
        self.buckets = 1 << bits
        used, slots = np.zeros(CLASSES, np.int64), np.zeros((CLASSES, size))
        own: list[tuple[int, int]] = []
        for word, count in frequent:
            kind = word % CLASSES
            if used[kind] < size - 1:
                own.append((word, int(used[kind])))
                slots[kind, used[kind]] = count
                used[kind] += 1
        own.sort()
        self.own, self.place = np.array([w for w, _ in own], np.uint64), np.array([k for _, k in own], np.int64)
        self.rest, self.rest_words = totals - slots.sum(1), distinct - used
        slots[:, -1] = self.rest + 0.5 * (self.rest_words + 1)
        self.weights = [np.zeros((t * self.buckets + rows, width), np.float32) for t, rows, width in zip(TEMPLATES, (1, CLASSES), (CLASSES, size), strict=True)]
        self.weights[0][-1] = np.log(totals + 0.5)
        with np.errstate(divide="ignore"):
            self.weights[1][-CLASSES:] = np.maximum(np.log(slots), -60)  # places without a word

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word in its class."""
        out = np.full(len(hashes), self.size - 1)
        if len(self.own):
            at = np.minimum(np.searchsorted(self.own, hashes), len(self.own) - 1)
            out = np.where(self.own[at] == hashes, self.place[at], out)
        return out

    def rows(self, hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of both weights for every token, biases last; what would stand before the text is word and class 0."""
        n, b = len(hashes), self.buckets
        place = np.arange(n) - np.repeat(ends[:-1], np.diff(ends))
        words, classes = (np.zeros((3, n), np.uint64) for _ in range(2))
        for k in (1, 2, 3):
            words[k - 1, k:] = np.where(place[k:] >= k, hashes[:-k], np.uint64(0))
            classes[k - 1, k:] = np.where(place[k:] >= k, (hashes[:-k] & np.uint64(CLASSES - 1)) + np.uint64(1), np.uint64(0))
        kind = hashes & np.uint64(CLASSES - 1)
        many, mask = np.uint64(CLASSES + 1), np.uint64(b - 1)
        bucket = lambda x, salt: (mixed(x + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)) & mask).astype(np.int64)
        first = np.stack([bucket(words[0], 1), b + bucket(classes[0] * many + classes[1], 2), 2 * b + bucket(classes[1] * many + classes[2], 3), np.full(n, 3 * b)])
        second = np.stack([bucket(mixed(words[0]) + kind, 4), b + bucket(mixed(words[1]) + kind, 5), 2 * b + kind.astype(np.int64)])
        return first, second

    def log10(self, rows: tuple[np.ndarray, np.ndarray], targets: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Of every token the log10 probability of its class and of its place there."""
        out = np.zeros(len(targets[0]))
        for weights, of, target in zip(self.weights, rows, targets, strict=True):
            for k in range(0, len(out), BATCH):
                z, t = _logits(weights, of[:, k : k + BATCH]), target[k : k + BATCH]
                out[k : k + BATCH] += (z[np.arange(len(t)), t] - np.log(np.exp(z).sum(1))) / math.log(10)
        return out

    def shares(self, hashes: np.ndarray, counts: np.ndarray, places: np.ndarray) -> np.ndarray:
        """log10 of a word's share of its place: all of it, or by counts among the words that have none of their own."""
        kind = classes_of(hashes)
        return np.where(places < self.size - 1, 0.0, np.log10((counts + 0.5) / (self.rest + 0.5 * (self.rest_words + 1))[kind]))


def _logits(weights: np.ndarray, of: np.ndarray) -> np.ndarray:
    z = weights[of[0]]
    for row in of[1:]:
        z += weights[row]
    z -= z.max(1, keepdims=True)
    return z


def learn(weights: np.ndarray, past: np.ndarray, rows: np.ndarray, target: np.ndarray) -> None:
    """Gradient steps of a size that falls with the past gradients of each row; biases, the last of ``rows``, stay as they are."""
    for k in range(0, len(target), BATCH):
        part, t = rows[:, k : k + BATCH], target[k : k + BATCH]
        p = _logits(weights, part)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(t)), t] -= 1
        for row in part[:-1]:
            low = row.min()
            order = np.argsort((row - low).astype(np.uint16 if row.max() - low < 1 << 16 else np.uint32), kind="stable")
            row = row[order]
            at = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            gradient, row = np.add.reduceat(p[order], at), row[at]
            past[row] += (gradient * gradient).mean(1)
            weights[row] -= RATE * gradient / np.sqrt(past[row])[:, None]


def _learned(blocks: DataFrame, model: Model) -> DataFrame:
    """Sums of the moves of all tasks by packets of rows, and how many tasks moved a row."""
    held = blocks.sparkSession.sparkContext.broadcast(model)
    schema = "softmax int, packet int, salt int, seen binary, moved binary"

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tokens = held.value, 0
        weights = [w.copy() for w in model.weights]
        past = [np.full(len(w), PRIOR, np.float32) for w in weights]
        for batch in batches:
            for row in batch.to_pylist():
                ends, train = unzipped(row["ends"], np.int64), unzipped(row["train"], bool)
                hashes = unzipped(row["hashes"], np.uint64)[unzipped(row["codes"], np.int32)]
                keep = np.repeat(train, np.diff(ends))
                own = hashes[keep]
                for w, p, rows, target in zip(weights, past, model.rows(hashes, ends), (classes_of(own), model.places(own)), strict=True):
                    learn(w, p, rows[:, keep], target)
                tokens += len(own)
                released()
        salt = TaskContext.get().partitionId() % SUM_PARTS
        for k in range(2 if tokens else 0):
            moved, seen = weights[k] - model.weights[k], past[k] > PRIOR
            packets = [j for j in range(0, len(moved), PACKET) if seen[j : j + PACKET].any()]
            columns = [pa.array([x] * len(packets), pa.int32()) for x in (k, salt)]
            columns = [columns[0], pa.array([j // PACKET for j in packets], pa.int32()), columns[1]]
            columns += [pa.array([zipped(x[j : j + PACKET]) for j in packets], pa.binary()) for x in (seen.astype(np.int32), moved.astype(np.float16))]
            yield pa.RecordBatch.from_arrays(columns, _names(schema))

    def added(kind: type):
        def add(parts: pa.Table) -> pa.Table:
            seen = sum(unzipped(x, np.int32) for x in parts.column("seen").to_pylist())
            moved = sum(unzipped(x, kind).astype(np.float32) for x in parts.column("moved").to_pylist())
            first = [parts.column(c)[:1] for c in ("softmax", "packet", "salt")]
            return pa.table([*first, pa.array([zipped(seen)], pa.binary()), pa.array([zipped(moved)], pa.binary())], names=_names(schema))

        return add

    moves = blocks.select("train", "ends", "codes", "hashes").mapInArrow(update, schema)
    keys = ["softmax", "packet"]
    return moves.groupBy(*keys, "salt").applyInArrow(added(np.float16), schema).groupBy(*keys).applyInArrow(added(np.float32), schema)


def trained(blocks: DataFrame, counts: DataFrame, size: int = SLOTS) -> Model:
    """A model that has learned once from every row to learn from."""

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stats in batch.column(0).to_pylist():
                totals, distinct = unzipped(stats, np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(totals), pa.array(distinct)], ["class", "total", "distinct"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for best in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([*map(pa.array, unzipped(best, np.int64).reshape(2, -1))], ["hash", "total"])

    of_ranges = counts.filter("group = -1")
    sums = np.zeros((2, CLASSES), np.int64)
    for row in of_ranges.select("counts").mapInArrow(classes, "class long, total long, distinct long").groupBy("class").sum("total", "distinct").collect():  # a row for each class
        sums[:, row["class"]] = row["sum(total)"], row["sum(distinct)"]
    # A class's frequent words are among so many of all, or have to do with fewer places.
    frequent = of_ranges.select("top").mapInArrow(words, "hash long, total long").filter("total > 0").orderBy(F.desc("total"), "hash").limit(4 * CLASSES * size).collect()
    model = Model(*sums, [(r["hash"] % 2**64, r["total"]) for r in frequent], size)
    tasks = max(1, blocks.count() // (ROUNDS * TASK_BLOCKS))
    for k in range(ROUNDS):
        part = blocks.filter(F.pmod(F.xxhash64("block"), F.lit(ROUNDS)) == k).coalesce(tasks)
        for row in _learned(part, model).collect():  # the weights: a bounded number of packets
            weights = model.weights[row["softmax"]]
            seen, moved = unzipped(row["seen"], np.int32), unzipped(row["moved"], np.float32).reshape(-1, weights.shape[1])
            weights[row["packet"] * PACKET :][: len(moved)] += moved / np.maximum(seen, 1)[:, None]
    return model


def lm_scores(docs: DataFrame, train: Column, size: int = SLOTS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row, learned from the rows where ``train`` holds.

    A null text is empty: its one token is the end. Without a row to learn from, all words are unknown. Repeated
    rows are scored alike and count each; an empty table gives an empty one; a text longer than a block is a block alone. Other columns
    are left out. base_score is the unigram's, score the model's log10 probability of the text.
    """
    blocks = written(coded_blocks(docs, train), "lm-blocks")
    counts = written(word_counts(blocks, 4 * CLASSES * size), "lm-counts")
    return scores(docs, blocks, counts, trained(blocks, counts, size))


def scores(docs: DataFrame, blocks: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """The rows of ``lm_scores`` by a model that has been trained. ``docs`` gives the type of doc_id."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = docs.select("doc_id").limit(0).toArrow().schema.field(0).type
    schema = f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def score(group: pa.Table, replies: pa.Table) -> pa.Table:
        out, model = [], held.value
        group = group.sort_by("block")
        words = [unzipped(x, np.uint64) for x in group.column("words").to_pylist()][-1:]
        total = np.concatenate([unzipped(x, np.int64) for x in replies.sort_by("part").column("counts").to_pylist()])
        for rows, ends, codes, hashes in zip(*(group.column(c) for c in ("rows", "ends", "codes", "hashes")), strict=True):
            codes, ends, hashes = unzipped(codes.as_py(), np.int32), unzipped(ends.as_py(), np.int64), unzipped(hashes.as_py(), np.uint64)
            count = total[np.searchsorted(words[0], hashes)]
            places = model.places(hashes)
            base = np.log10((count + 0.5) / (model.n + 0.5 * (model.v + 1)))
            full = model.log10(model.rows(hashes[codes], ends), (classes_of(hashes)[codes], places[codes])) + model.shares(hashes, count, places)[codes]
            sums = [np.add.reduceat(x, ends[:-1]) for x in ((count > 0)[codes].astype(np.int64), base[codes], full)]
            ids = ids_of(rows.as_py(), id_type)
            lengths = np.diff(ends)
            released()
            out.append(pa.table([ids, pa.array(lengths), pa.array(sums[0]), pa.array(np.full(len(lengths), model.n)), pa.array(sums[1]), pa.array(sums[2])], names=_names(schema)))
        if not out:
            return pa.schema([("doc_id", id_type), *((c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())]).empty_table()
        return pa.concat_tables(out)

    asked = blocks.select("block", "group", "rows", "ends", "codes", "hashes", "words").groupBy("group")
    return asked.cogroup(counts.filter("group >= 0").select("group", "part", "counts").groupBy("group")).applyInArrow(score, schema)
