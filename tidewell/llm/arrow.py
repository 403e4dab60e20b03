"""Small helpers for Arrow batches inside tasks."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a task works on at once; longer texts are worked on alone.
SLICE_BYTES = 8 << 20
#: Bytes of a batch on its way to Python, which the task's JVM and its worker both hold; a longer row goes alone.
BATCH_LIMIT = 8 << 20
#: Bytes that are hashed at once, for which arrays of powers are kept.
HASH_BYTES = (1 << 18) - 1


def released() -> None:
    """Gives freed memory back to the machine: workers live on between tasks, and an executor has several."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the session's batches by bytes too, as ten thousand rows may have any number of them. A limit that the session was given stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_LIMIT))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch cut by bytes: the rows, the UTF-8 bytes of their texts one after the other, and len(rows) + 1 offsets. Null is empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = pc.fill_null(batch.column(column).cast(pa.large_binary()), b"")
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
            at = to
            released()


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def word_spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes, which never cross texts, and the words before each text (len(offsets) counts)."""
    n = len(is_word)
    edges = np.zeros(n + 2, bool)
    edges[1:-1] = is_word
    first, last = edges[1:-1] & ~edges[:-2], edges[1:-1] & ~edges[2:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = is_word[heads]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[tails] = is_word[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """The byte strings data[start:end]; the spans are in order and don't overlap."""
    edges = np.empty(2 * len(starts) + 1, np.int64)
    edges[0:-1:2], edges[1::2], edges[-1] = starts, ends, ends[-1] if len(ends) else 0
    every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    return every.take(pa.array(np.arange(0, 2 * len(starts), 2)))


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result depends on every bit of ``h``."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: Hashes are polynomials modulo this prime, at two bases each. Modulo a power of two, texts are easily made that all bases take for one.
_PRIME = np.uint64(2**31 - 1)
_BASES = ((1_103_515_245, 742_938_285), (950_706_376, 1_226_874_159))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    row = _POWERS.get(base, np.ones(1, np.uint32))
    while len(row) < n:
        row = np.concatenate([row, (row * np.uint64(pow(base, len(row), int(_PRIME))) % _PRIME).astype(np.uint32)])
    if len(row) <= HASH_BYTES + 1:  # workers live on: longer ones are not kept
        _POWERS[base] = row
    return row


def _folded(x: np.ndarray) -> np.ndarray:
    return (x & _PRIME) + (x >> np.uint64(31))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of the runs values[start:end], from prefix sums. ``values``: whole numbers below 2**31; ``salt``: one of two independent hashes."""
    n, found = len(values), []
    for base in _BASES[salt]:
        sums = np.zeros(n + 1, np.uint64)
        terms = values.astype(np.uint64) * _powers(base, n)[:n]
        np.cumsum(terms if values.dtype == np.uint16 and n <= HASH_BYTES else _folded(terms), out=sums[1:])
        back = _powers(pow(base, -1, int(_PRIME)), n + 1)
        found.append(_folded(_folded(sums[ends] - sums[starts])) * back[starts] % _PRIME)
    return mixed((found[0] << np.uint64(32) | found[1]) ^ mixed((ends - starts).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], spans in order. Long data are summed in parts."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + HASH_BYTES, "right")))
        low, part = starts[at], data[starts[at] : ends[to - 1]]
        out[at:to] = run_hashes(part.astype(np.uint16) + np.uint16(1), starts[at:to] - low, ends[at:to] - low)
        at = to
    return out


def hash_ranges(hashes: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """number, begin, end of each of ``ranges`` equal ranges that sorted 64-bit hashes fall into; ranges without one cost nothing."""
    number = (hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    at = np.flatnonzero(np.append(True, number[1:] != number[:-1])[: len(hashes)])
    return list(zip(number[at].tolist(), at.tolist(), [*at[1:].tolist(), len(hashes)], strict=False))


def free_name(columns: list[str], name: str) -> str:
    """``name``, with more underscores in front if ``columns`` has it, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def plain_names(docs: DataFrame, but: tuple[str, ...] = ("doc_id", "text")) -> list[str]:
    """A name for each column by its place, as Arrow functions don't take all names; those of ``but`` stay."""
    return [c if c in but else f"_c{k}" for k, c in enumerate(docs.columns)]


def quoted(name: str) -> str:
    """A column's name as SQL and schema strings take it, whatever it contains."""
    return "`" + name.replace("`", "``") + "`"


def zipped(values: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unzipped(data: bytes, kind: type) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.Codec("zstd").decompress(data[8:], n, asbytes=True), kind)


def ids_stream(rows: pa.RecordBatch) -> bytes:
    """The column doc_id as an Arrow stream, whatever its type."""
    sink = pa.BufferOutputStream()
    part = rows.select(["doc_id"])
    with pa.ipc.new_stream(sink, part.schema) as out:
        out.write_batch(part)
    return sink.getvalue().to_pybytes()


def ids_of(stream: bytes, kind: pa.DataType) -> pa.Array:
    return pa.ipc.open_stream(stream).read_all().column("doc_id").combine_chunks().cast(kind)
