"""Token ids and counts of whole texts, with the tokenizers library, inside Arrow functions.

A text is cut at safe boundaries, before a single space between two visible characters, where the
tokenizer's own pattern always begins a new piece. What lies between two cuts is encoded once for
each distinct string of a batch; batches are balanced by bytes.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.arrow import bounded_batches, text_slices

#: Bytes of texts whose strings are told apart at once.
BATCH_BYTES = 8 << 20
#: Bytes of distinct strings that are encoded as one text.
JOINED_BYTES = 1 << 15
#: Texts that are encoded together; what the library returns is many times their size.
TEXTS_AT_ONCE = 32


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """Positions before which a new piece of the tokenizer's pattern begins, whatever stands around.

    Both neighbours of the space are printable ASCII or letters U+00C0 to U+00FF (with the two signs among them).
    """
    if len(data) < 3:
        return np.zeros(0, np.int64)
    spaces = np.flatnonzero(data[1:-1] == 32) + 1
    before, earlier = data[spaces - 1], data[np.maximum(spaces - 2, 0)]
    ok = (_VISIBLE[before] | ((before >= 0x80) & (earlier == 0xC3) & (spaces > 1))) & _BEGINS[data[spaces + 1]]
    return spaces[ok]


class Pieces:
    """The tokenizer, and how to encode many strings between cuts at once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for k in range(0, len(texts), TEXTS_AT_ONCE):
            found = self.tokenizer.encode_batch_fast([t.decode("utf-8") for t in texts[k : k + TEXTS_AT_ONCE]], add_special_tokens=False)
            out += [np.array(e.ids, np.uint32) for e in found]
        return out

    def distinct_ids(self, strings: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all strings, and where each one's begin and how many they are.

        Strings that begin and end at a cut are encoded joined, and told apart by the widths of their tokens.
        """
        edges, data = edges_and_data(strings)
        lengths = np.diff(edges)
        ids, starts, counts = [], np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        n_ids = 0
        joinable = lengths > 1
        at = edges[:-1][joinable]
        last = edges[1:][joinable] - 1
        joinable[joinable] = (data[at] == 32) & _BEGINS[data[at + 1]] & (_VISIBLE[data[last]] | ((data[last] >= 0x80) & (data[last - 1] == 0xC3)))
        rest = np.flatnonzero(~joinable)
        if joinable.any():
            which = np.flatnonzero(joinable)
            joined_edges, joined = edges_and_data(strings.take(pa.array(which)))
            groups = np.searchsorted(joined_edges, np.arange(0, joined_edges[-1] + JOINED_BYTES, JOINED_BYTES))
            groups = np.unique(np.append(np.minimum(groups, len(which)), len(which)))
            texts = [joined[joined_edges[a] : joined_edges[b]].tobytes() for a, b in zip(groups[:-1], groups[1:], strict=True)]
            found = np.concatenate(self.ids(texts))
            cum = np.cumsum(self.width[found])
            to = np.searchsorted(cum, joined_edges[1:]) + 1
            if cum[-1] == joined_edges[-1] and np.array_equal(cum[to - 1], joined_edges[1:]):
                starts[which], counts[which] = np.append(0, to[:-1]), np.diff(to, prepend=0)
                ids.append(found)
                n_ids = len(found)
            else:  # tokens whose widths don't add up to the bytes
                rest = np.arange(len(lengths))
        for k in range(0, len(rest), 10_000):
            which = rest[k : k + 10_000]
            found = self.ids([data[edges[i] : edges[i + 1]].tobytes() for i in which])
            counts[which] = [len(x) for x in found]
            starts[which] = n_ids + np.cumsum(counts[which]) - counts[which]
            n_ids += int(counts[which].sum())
            ids += found
        return np.concatenate([np.zeros(0, np.uint32), *ids]), starts, counts

    def encode(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and start and number of those of each string; cuts: the edges of all strings, 0 and len(data) among them."""
        buffers = [None, pa.py_buffer(np.ascontiguousarray(cuts, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, buffers).dictionary_encode()
        ids, starts, counts = self.distinct_ids(coded.dictionary)
        which = coded.indices.to_numpy()
        return ids, starts[which], counts[which]


_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_BEGINS = _VISIBLE.copy()
_BEGINS[0xC3] = True


def edges_and_data(strings: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2], np.uint8) if strings.buffers()[2] else np.zeros(0, np.uint8)
    return edges - edges[0], data[edges[0] :]


_KEPT: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _KEPT:
        _KEPT[path] = Pieces(path)
    return _KEPT[path]


#: For each text of a slice, or once for a long text's each part: ids, starts and counts of its strings.
Encoded = tuple[np.ndarray, np.ndarray, np.ndarray]


def encoded_slices(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, list[Encoded], np.ndarray]]:
    """Rows, their encoded parts, and for a slice of one part the edges of texts in its strings.

    Long texts, alone in their slice, are encoded in parts that end at safe cuts.
    """
    pieces = pieces_of(path)
    for rows, data, offsets in text_slices(batches, limit=BATCH_BYTES):
        is_edge = np.zeros(len(data) + 1, bool)
        is_edge[safe_cuts(data)] = True
        is_edge[offsets] = True
        edges = np.flatnonzero(is_edge)
        if len(data) <= BATCH_BYTES:
            part = pieces.encode(data, edges) if len(data) else (np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield rows, [part], np.searchsorted(edges, offsets)
            continue
        parts, at = [], 0
        while at < len(edges) - 1:
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + BATCH_BYTES, "right")) - 1)
            parts.append(pieces.encode(data[edges[at] : edges[to]], edges[at : to + 1] - edges[at]))
            at = to
        yield rows, parts, np.array([0, len(edges) - 1])


def token_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row's whole text, whatever other columns there are.

    A null or empty text has no tokens. Repeated rows give repeated rows; an empty table gives none.
    Only the counts leave the Arrow function.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, parts, at in encoded_slices(batches, tokenizer_path):
            if len(parts) > 1:
                n = np.array([sum(int(counts.sum()) for _, _, counts in parts)], np.int64)
            else:
                n = np.diff(np.append(0, np.cumsum(parts[0][2]))[at])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("n_bytes"), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
