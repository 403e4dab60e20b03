"""Removal of byte strings that occur twice, by merging the sparse transforms of shards.

Every 200-byte window has one anchor: of its 40-byte strings the one with the least hash, the leftmost of equals. Equal
windows have equal anchors at equal places, so windows are compared among those of one anchor. A shard
(a block of texts) keeps an entry for each anchor that is not the only one of its kind, in two orders of its own: by what follows the
anchor, its sparse suffix order, and by what precedes it, the order of the column that a Burrows-Wheeler transform has there.

A range's task merges the shards' orders by iterative interleave refinement, without sorting suffixes again. A shard's entries that are
equal so far are a run of its order. The interleave of runs begins with a run for each shard; each round reads eight bytes more, cuts runs
where those change, and puts the runs of one interval in their order, a shard's before the next one's; an interval of one entry
is closed. Where neighbours part gives their common prefix. A window reaches o bytes before its anchor and
200 - o behind: it is repeated when another entry shares both its interval of common prefix 200 - o and
its interval of common suffix o.

Anchors are counted by an aggregate of rows, and all entries of an anchor meet in one task. A hot anchor, of which there are more than HOT, has
no entries: its windows are hashed one by one (128 bits) and counted by ranges of those hashes, so that different surroundings part, and
of equal windows a block sends one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.arrow import hash_ranges, ids_of, ids_stream, mixed, released, span_hashes, text_slices, unzipped, zipped
from tidewell.llm.packing import gathered
from tidewell.session import written

#: Bytes of a repeated string, of an anchor, and offsets at which an anchor can lie in a window.
LENGTH, ANCHOR = 200, 40
OFFSETS = LENGTH - ANCHOR + 1
#: Bytes of an entry.
ENTRY = 8 + LENGTH + OFFSETS - 1 + 2
#: Bytes of texts in a block; positions that are looked at together.
BLOCK_BYTES, CHUNK = 4 << 20, 1 << 20
#: Entries that a range's task holds.
RANGE_ENTRIES = 60_000
#: An anchor in more places than this is hot; window hashes that a range's task holds.
HOT, RANGE_WINDOWS = 4000, 2_000_000

_BLOCK = "block long, n_anchors long, ids binary, text binary, offsets binary, anchors binary, firsts binary, lasts binary"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def anchors_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, and the first and last start of the windows that each one has; one text's after the other's."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    is_start = np.zeros(len(data) + 1, bool)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        is_start[a : max(a, b - LENGTH + 1)] = True
    heads = np.zeros(len(data) + 1, bool)
    heads[offsets] = True
    for low in range(0, len(data) - LENGTH + 1, CHUNK):
        windows = min(CHUNK, len(data) - LENGTH + 1 - low)
        part = data[low : low + windows + LENGTH - 1].astype(np.uint64) + np.uint64(1)
        # Hashes of 8, then 32, then 40 bytes.
        h, width = part, 1
        base = np.uint64(0x9E3779B97F4A7C15)
        powers = {1: base}
        kept = h
        for _ in range(5):
            h = h[: len(h) - width] * powers[width] + h[width:]
            powers[2 * width] = np.uint64((int(powers[width]) ** 2) % 2**64)
            width *= 2
            if width == 8:
                kept = h
        h = h[: len(h) - 8] * powers[8] + kept[32:]
        n = windows + OFFSETS - 1
        packed = (mixed(h[:n]) & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)
        rows = -(-n // OFFSETS) + 1
        grid = np.full(rows * OFFSETS, np.uint64(2**64 - 1))
        grid[:n] = packed
        grid = grid.reshape(rows, OFFSETS)
        ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        least = np.minimum(behind[:windows], ahead[OFFSETS - 1 : OFFSETS - 1 + windows])
        at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        ok = is_start[low : low + windows]
        new = np.append(True, at[1:] != at[:-1]) | heads[low : low + windows] | ~np.append(False, ok[:-1])
        first = np.flatnonzero(new & ok)
        ends = np.flatnonzero(ok & np.append(new[1:] | ~ok[1:], True))
        found.append((at[first] + low, first + low, ends + low))
    return tuple(np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in range(3))


def text_blocks(docs: DataFrame) -> DataFrame:
    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = (TaskContext.get().partitionId() + 1) << 32
        for k, (rows, data, offsets) in enumerate(text_slices(batches, limit=BLOCK_BYTES)):
            found = anchors_of(data, offsets)
            binary = [ids_stream(rows), zipped(data), zipped(offsets), *(zipped(x) for x in found)]
            yield pa.RecordBatch.from_arrays([pa.array([first + k]), pa.array([len(found[0])]), *(pa.array([b], pa.binary()) for b in binary)], _names(_BLOCK))

    return docs.select("doc_id", "text").mapInArrow(block, _BLOCK)


class _Shard:
    """A block's texts and anchors."""

    def __init__(self, row: dict):
        self.data, self.offsets = unzipped(row["text"], np.uint8), unzipped(row["offsets"], np.int64)
        self.at, self.first, self.last = (unzipped(row[c], np.int64) for c in ("anchors", "firsts", "lasts"))
        self.hashes = span_hashes(self.data, self.at, self.at + ANCHOR)
        order = np.argsort(self.hashes, kind="stable")
        head = np.append(True, self.hashes[order][1:] != self.hashes[order][:-1])[: len(order)]
        self.distinct = self.hashes[order][head]
        self.kind = np.empty(len(order), np.int64)
        self.kind[order] = np.cumsum(head) - 1
        self.counts = np.bincount(self.kind, minlength=len(self.distinct))

    def windows(self, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the anchors whose kind is hot: the windows' starts, the distinct windows' two hashes in order, each start's window, and which have several."""
        which = np.flatnonzero(hot[self.kind])
        at = gathered(self.first[which], self.last[which] - self.first[which] + 1, np.arange(len(self.data)))
        h = np.empty((len(at), 2), np.uint64)
        salted = mixed(np.arange(256, dtype=np.uint64) + np.uint64(0xA0761D6478BD642F))
        for k in range(0, len(at), CHUNK):
            part = at[k : k + CHUNK]
            h[k : k + CHUNK, 0] = span_hashes(self.data, part, part + LENGTH)
            h[k : k + CHUNK, 1] = _window_hashes(self.data, part, salted)
        order = np.lexsort((h[:, 1], h[:, 0]))
        h = h[order]
        head = np.append(True, (h[1:] != h[:-1]).any(1))[: len(order)]
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(head) - 1
        distinct = h[head]
        return at, distinct, of, np.bincount(of, minlength=len(distinct)) > 1

    def entries(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the anchors whose kind is repeated: their places, the distinct entries in order, each place's entry, and how many have it.

        An entry is a row of bytes: the anchor's hash, what follows up to the last window's end, what precedes down to the first one's
        start, backwards, both with zeros behind, and the least and most offset of an anchor in its windows.
        """
        which = np.flatnonzero(repeated[self.kind])
        every = np.zeros((len(which), ENTRY), np.uint8)
        for k in range(0, len(which), 20_000):
            part, at = every[k : k + 20_000], self.at[which[k : k + 20_000]]
            low, high = at - self.last[which[k : k + 20_000]], at - self.first[which[k : k + 20_000]]
            part[:, :8] = self.hashes[which[k : k + 20_000]].astype(">u8").view(np.uint8).reshape(-1, 8)
            for place, step, size, reach in ((8, 1, LENGTH, LENGTH - low), (8 + LENGTH, -1, OFFSETS - 1, high)):
                ahead = np.arange(size)
                bytes_at = np.clip((at if step > 0 else at - 1)[:, None] + step * ahead, 0, len(self.data) - 1)
                part[:, place : place + size] = np.where(ahead < reach[:, None], self.data[bytes_at], 0)
            part[:, -2], part[:, -1] = low, high
        coded = pa.FixedSizeBinaryArray.from_buffers(pa.binary(ENTRY), len(which), [None, pa.py_buffer(every)]).dictionary_encode()
        distinct = np.frombuffer(coded.dictionary.buffers()[1], np.uint8)[: len(coded.dictionary) * ENTRY].reshape(-1, ENTRY)
        order = np.argsort(np.ascontiguousarray(distinct).view(f"S{ENTRY}").reshape(-1), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        of = rank[coded.indices.to_numpy()] if len(which) else np.zeros(0, np.int64)
        return which, distinct[order], of, np.bincount(of, minlength=len(order))


def _window_hashes(data: np.ndarray, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Second hashes of data[start:start + LENGTH], starts in order: another base, and a value of its own for each byte."""
    out = np.empty(len(starts), np.uint64)
    base = 0xD6E8FEB86659FD93
    up, down = (np.cumprod(np.append(np.uint64(1), np.full(CHUNK + LENGTH, x, np.uint64)), dtype=np.uint64) for x in (base, pow(base, -1, 2**64)))
    k = 0
    while k < len(starts):
        to = int(np.searchsorted(starts, starts[k] + CHUNK, "right"))
        part = values[data[starts[k] : starts[to - 1] + LENGTH]]
        sums = np.append(np.uint64(0), np.cumsum(part * up[: len(part)], dtype=np.uint64))
        a = starts[k:to] - starts[k]
        out[k:to] = mixed((sums[a + LENGTH] - sums[a]) * down[a])
        k = to
    return out


#: kind 0 and 1: a block's repeated anchors and its hot ones; 2: bits of entries; 3: of windows of hot anchors.
_REPLY = "block long, kind int, part long, reply binary"
_REPEATED, _HOT, _ENTRIES, _WINDOWS = range(4)


def repeated_anchors(blocks: DataFrame) -> tuple[DataFrame, int, int]:
    """For each block the hashes of those of its anchors that occur twice in all blocks, and of those that are hot; and how many places either have."""

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = _Shard(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(shard.distinct), row["block"])), pa.array(shard.distinct.view(np.int64)), pa.array(shard.counts)], ["block", "hash", "n"])
                released()

    def packed(rows: pa.Table) -> pa.Table:
        hashes, hot = np.sort(rows.column("hash").to_numpy().view(np.uint64)), rows.column("hot")[0].as_py()
        return _replies(rows.column("block")[:1], _HOT if hot else _REPEATED, pa.array([0]), [zipped(hashes)])

    listed = written(blocks.select("block", "text", "offsets", "anchors", "firsts", "lasts").mapInArrow(listing, "block long, hash long, n long"), "repeat-listed")
    totals = written(listed.groupBy("hash").agg(F.sum("n").alias("total")).filter("total > 1"), "repeat-totals")
    found = listed.join(totals, "hash").select("block", "hash", (F.col("total") > HOT).alias("hot"))
    places = totals.agg(*[F.coalesce(F.sum(F.when(hot, F.col("total"))), F.lit(0)) for hot in (F.col("total") <= HOT, F.col("total") > HOT)]).first()
    return found.groupBy("block", "hot").applyInArrow(packed, _REPLY), *places


def _replies(blocks, kind: int, parts, replies: list[bytes]) -> pa.Table:
    n = len(replies)
    return pa.table([blocks, pa.array([kind] * n, pa.int32()), parts, pa.array(replies, pa.binary())], names=_names(_REPLY))


def _states(answers: pa.Table, shard: _Shard) -> np.ndarray:
    """_REPEATED, _HOT or -1 for each of the shard's distinct anchors."""
    states = np.full(len(shard.distinct), -1)
    for kind in (_REPEATED, _HOT):
        for reply in _bits(answers, kind):
            states[np.searchsorted(shard.distinct, unzipped(reply, np.uint64))] = kind
    return states


def repeated_hot_windows(blocks: DataFrame, replies: DataFrame, ranges: int) -> DataFrame:
    """For each block and range of hashes, which of the distinct windows of its hot anchors occur twice in all blocks."""
    schema = "block long, part long, hashes binary, several binary"

    def ask(block: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in block.to_pylist():
            shard = _Shard(row)
            _, distinct, _, several = shard.windows(_states(answers, shard) == _HOT)
            released()
            out += [(row["block"], part, zipped(distinct[a:b]), zipped(several[a:b])) for part, a, b in hash_ranges(distinct[:, 0], ranges)]
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.binary(), pa.binary()], strict=True)], names=_names(schema))

    def answer(asked: pa.Table) -> pa.Table:
        hashes = [unzipped(x, np.uint64).reshape(-1, 2) for x in asked.column("hashes").to_pylist()]
        twice = np.concatenate([unzipped(x, bool) for x in asked.column("several").to_pylist()])
        ends = np.cumsum([0, *map(len, hashes)])
        every = np.concatenate(hashes)
        order = np.lexsort((every[:, 1], every[:, 0]))
        same = (every[order[1:]] == every[order[:-1]]).all(1)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        released()
        return _replies(asked.column("block"), _WINDOWS, asked.column("part"), [zipped(twice[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)])

    left = blocks.select("block", "text", "offsets", "anchors", "firsts", "lasts").groupBy("block")
    return left.cogroup(replies.groupBy("block")).applyInArrow(ask, schema).groupBy("part").applyInArrow(answer, _REPLY)


def _bits(replies: pa.Table, kind: int) -> list[bytes]:
    rows = [(r["part"], r["reply"]) for r in replies.to_pylist() if r["kind"] == kind]
    return [reply for _, reply in sorted(rows)]


def shard_entries(blocks: DataFrame, replies: DataFrame, ranges: int) -> DataFrame:
    """Each block's distinct entries by ranges of hashes, in order of what follows, with their numbers and their order by what precedes."""
    schema = "block long, part long, entries binary, counts binary, backward binary"

    def entries(block: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in block.to_pylist():
            shard = _Shard(row)
            _, values, _, counts = shard.entries(_states(answers, shard) == _REPEATED)
            released()
            for part, a, b in hash_ranges(_hashes(values), ranges):
                own = values[a:b]
                column = np.concatenate([own[:, :8], own[:, 8 + LENGTH : -2]], 1)
                backward = np.argsort(column.view(f"S{column.shape[1]}").reshape(-1), kind="stable")
                out.append((row["block"], part, zipped(own), zipped(counts[a:b]), zipped(backward)))
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_names(schema))

    left = blocks.select("block", "text", "offsets", "anchors", "firsts", "lasts").groupBy("block")
    return left.cogroup(replies.groupBy("block")).applyInArrow(entries, schema)


def _hashes(entries: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(entries[:, :8]).view(">u8").reshape(-1).astype(np.uint64)


def _symbols(entries: np.ndarray, first: int, size: int) -> np.ndarray:
    """The hash and ``size`` bytes from ``first`` on, as words of eight bytes, a row for each."""
    out = np.zeros((len(entries), 8 + -(-size // 8) * 8), np.uint8)
    out[:, :8], out[:, 8 : 8 + size] = entries[:, :8], entries[:, first : first + size]
    return out.view(">u8").T.astype(np.uint64)


def interleaved(symbols: np.ndarray, shards: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The merged order of entries, and what each has in common with the one before, in bytes; -1 where the hash changes.

    symbols: rows of words, of all shards' entries one shard after the other, each shard's in its own order of those words, the hash first.
    shards: where each shard's begin, and their end. Only runs of a shard's order are moved, never entries of one against each other.
    """
    n = len(symbols[0])
    common = np.full(n, 8 * (len(symbols) - 1), np.int64)
    first, size = shards[:-1][np.diff(shards) > 0], np.diff(shards)[np.diff(shards) > 0]  # the runs, in the order of the interleave
    new = np.zeros(len(first), bool)  # whether an interval begins with a run
    new[:1] = True
    common[:1] = -1
    for j, words in enumerate(symbols):
        held = np.add.reduceat(size, np.flatnonzero(new)) if len(new) else np.zeros(0, np.int64)
        is_open = np.repeat(held > 1, np.diff(np.append(np.flatnonzero(new), len(new))))
        if not is_open.any():
            break
        a, length = first[is_open], size[is_open]
        at = gathered(a, length, np.arange(n))
        head = np.zeros(len(at), bool)
        head[np.cumsum(length) - length] = True
        word = words[at]
        head[1:] |= word[1:] != word[:-1]
        cut = np.flatnonzero(head)
        interval = np.repeat(np.cumsum(new)[is_open], length)[cut]
        order = np.lexsort((word[cut], interval))  # runs alone; a stable order keeps shards in theirs
        part_first, part_size, part_word, part_interval = at[cut][order], np.diff(np.append(cut, len(at)))[order], word[cut][order], interval[order]
        begins = np.append(True, part_interval[1:] != part_interval[:-1])
        parts = np.append(False, part_word[1:] != part_word[:-1]) & ~begins
        # Runs of open intervals take their places in the interleave again.
        owner = np.cumsum(new)
        every = np.concatenate([owner[~is_open], part_interval])
        place = np.argsort(every, kind="stable")
        first, size = (np.concatenate(x)[place] for x in ((first[~is_open], part_first), (size[~is_open], part_size)))
        split = np.concatenate([np.zeros((~is_open).sum(), bool), parts])[place]
        owner = every[place]
        new = np.append(True, owner[1:] != owner[:-1]) | split
        begin = (np.cumsum(size) - size)[split]
        common[begin] = -1 if j == 0 else 8 * (j - 1)
        if j:
            differ = (part_word[np.flatnonzero(parts)] ^ part_word[np.flatnonzero(parts) - 1])
            for bits in (32, 16, 8):  # equal leading bytes
                high = differ >> np.uint64(64 - bits) == 0
                common[begin] += np.where(high, bits // 8, 0)
                differ = np.where(high, differ << np.uint64(bits), differ)
    return gathered(first, size, np.arange(n)), common


def repeated_windows(entries: np.ndarray, counts: np.ndarray, backward: np.ndarray, shards: np.ndarray) -> np.ndarray:
    """For each entry and offset 0 to 160 whether the entry's window there occurs in another entry, or the entry twice."""
    n = len(entries)
    low, high = entries[:, -2].astype(np.int64), entries[:, -1].astype(np.int64)
    sides = [interleaved(_symbols(entries, 8, LENGTH), shards)]
    order, common = interleaved(_symbols(entries[backward], 8 + LENGTH, OFFSETS - 1), shards)
    sides.append((backward[order], common))
    out = np.zeros((n, OFFSETS), bool)
    ids = [np.empty(n, np.int64) for _ in range(2)]
    for o in range(OFFSETS):
        for k, depth in ((0, LENGTH - o), (1, o)):
            order, common = sides[k]
            ids[k][order] = np.cumsum((common < depth) | (common < 0))
        has = np.flatnonzero((low <= o) & (o <= high))
        if not len(has):
            continue
        key = ids[0][has] * (n + 1) + ids[1][has]
        by = np.argsort(key)
        same = key[by][1:] == key[by][:-1]
        twice = counts[has] > 1
        twice[by[1:][same]] = twice[by[:-1][same]] = True
        out[has, o] = twice
    return out


def merged_intervals(entries: DataFrame) -> DataFrame:
    """For each block's entries of a range the offsets at which their windows are repeated, as bits."""

    def merge(shards: pa.Table) -> pa.Table:
        rows = sorted(shards.to_pylist(), key=lambda r: r["block"])
        own = [unzipped(r["entries"], np.uint8).reshape(-1, ENTRY) for r in rows]
        ends = np.cumsum([0, *map(len, own)])
        backward = np.concatenate([unzipped(r["backward"], np.int64) + a for r, a in zip(rows, ends[:-1], strict=True)])
        found = repeated_windows(np.concatenate(own), np.concatenate([unzipped(r["counts"], np.int64) for r in rows]), backward, ends)
        bits = np.packbits(found, axis=1)
        released()
        replies = [zipped(bits[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return _replies(pa.array([r["block"] for r in rows]), _ENTRIES, pa.array([r["part"] for r in rows]), replies)

    return entries.groupBy("part").applyInArrow(merge, _REPLY)


def without_repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) of every row.

    A byte goes when a 200-byte string of its text that covers it also starts anywhere else, in the same text or another; all
    are judged on the input. Texts below 200 bytes, null and empty ones stay. Rows that repeat a text lose all of it if it
    has 200 bytes. An empty table gives an empty one; a text longer than a block is a block alone. ``kept`` can end within a character:
    it is binary. Other columns are left out.
    """
    blocks = written(text_blocks(docs), "repeat-blocks")
    first, n_repeated, n_hot = repeated_anchors(blocks)
    first = written(first, "repeat-anchors")
    entries = written(shard_entries(blocks, first, max(1, -(-n_repeated // RANGE_ENTRIES))), "repeat-entries")
    replies = first.unionByName(written(merged_intervals(entries), "repeat-intervals"))
    if n_hot:
        ranges = -(-n_hot * OFFSETS // RANGE_WINDOWS)
        replies = replies.unionByName(written(repeated_hot_windows(blocks, first, ranges), "repeat-windows"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = docs.select("doc_id").limit(0).toArrow().schema.field(0).type
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def remove(block: pa.Table, answers: pa.Table) -> pa.Table:
        tables = []
        for row in block.to_pylist():
            shard = _Shard(row)
            states = _states(answers, shard)
            which, _, of, _ = shard.entries(states == _REPEATED)
            bits = [unzipped(x, np.uint8).reshape(-1, -(-OFFSETS // 8)) for x in _bits(answers, _ENTRIES)]
            found = np.unpackbits(np.concatenate(bits), axis=1, count=OFFSETS) if bits else np.zeros((0, OFFSETS), np.uint8)
            change = np.zeros(len(shard.data) + 1, np.int32)
            for k in range(0, len(which), 10_000):
                place, offset = np.nonzero(found[of[k : k + 10_000]])
                start = shard.at[which[k : k + 10_000]][place] - offset
                change[start] += 1
                change[start + LENGTH] -= 1
            if (states == _HOT).any():
                start, _, of, _ = shard.windows(states == _HOT)
                start = start[np.concatenate([unzipped(x, bool) for x in _bits(answers, _WINDOWS)])[of]]
                change[start] += 1
                change[start + LENGTH] -= 1
            gone = np.cumsum(change[:-1]) > 0
            a = np.append(0, np.cumsum(gone))[shard.offsets]
            heads = gone & ~np.append(False, gone[:-1])
            begins = shard.offsets[:-1][np.diff(shard.offsets) > 0]
            heads[begins] = gone[begins]
            spans = np.append(0, np.cumsum(heads))[shard.offsets]
            kept = shard.data[~gone].tobytes()
            released()
            at = shard.offsets - a
            texts = [kept[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
            columns = [ids_of(row["ids"], id_type), *(pa.array(np.diff(x)) for x in (shard.offsets, a, spans))]
            tables.append(pa.table([*columns, pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(texts, pa.binary())], names=_names(schema)))
        kinds = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.concat_tables(tables) if tables else pa.schema(list(zip(_names(schema), kinds, strict=True))).empty_table()

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(remove, schema)
