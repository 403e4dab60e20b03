import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewell.llm import tokens
from tidewell.llm.packing import pack_documents, packed, packing_plan
from tidewell.llm.sharding import shard_ids, write_shards
from tidewell.llm.tokens import Pieces, safe_cuts, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)


def ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"ab 's.\n\t1é日🙂 　ÿ×", "<|endoftext|>", "  ", " don't", "'ll"]), max_size=60).map("".join))
def test_cuts_are_safe(text):
    data = np.frombuffer(text.encode(), np.uint8)
    edges = np.unique(np.concatenate([[0], safe_cuts(data), [len(data)]])).astype(np.int64)
    if len(data):
        found, starts, counts = _PIECES.encode(data, edges)
        assert [int(x) for s, n in zip(starts, counts, strict=True) for x in found[s : s + n]] == ids(text)


_PIECES = Pieces(PATH)


def test_counts(odd, odd_rows, nothing):
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts(odd, PATH).collect())
    assert got == Counter((d, len((t or "").encode()), len(ids(t))) for d, t in odd_rows)
    assert token_counts(nothing, PATH).count() == 0


def test_long_texts_are_cut(odd_rows, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "BATCH_BYTES", 500)
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in odd_rows]), pa.array([t for _, t in odd_rows])], ["doc_id", "text"])
    found = {}
    for rows, parts, at in tokens.encoded_slices(iter([batch]), PATH):
        every = np.append(0, np.cumsum(np.concatenate([c for _, _, c in parts])))[at]
        found |= dict(zip(rows.column("doc_id").to_pylist(), np.diff(every).tolist(), strict=True))
    assert found == {d: len(ids(t)) for d, t in odd_rows}


def test_packing(odd, odd_rows, nothing):
    capacity = 128
    got = pack_documents(odd, PATH, capacity).collect()
    whole = Counter((d, t) for d, t in odd_rows)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for (d, t), copies in whole.items():
        every = np.array([*ids(t), 0], "<u4")
        first = len(every) if len(every) <= capacity else (len(every) - 1) % capacity + 1
        edges = [0, *range(first, len(every) + 1, capacity)]
        want = Counter({(k, a, b - a, zlib.crc32(every[a:b].tobytes())): copies for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))})
        assert Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[d]) == want
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in got)
    assert len(by_sequence) <= 1.05 * total / capacity + 1
    assert pack_documents(nothing, PATH, capacity).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_plans_fill_bins(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 97, 300])
    counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 900)))
    bins, ranks = defaultdict(int), defaultdict(list)
    for length, first, number, each, start, offset in packing_plan(dict(counts), capacity):
        ranks[length] += range(first, first + number * each)
        for b in range(start, start + number):
            assert bins[b] == offset
            bins[b] += each * length
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    assert all(b <= capacity for b in bins.values())
    large = sum(n for k, n in counts.items() if 2 * k > capacity)
    assert len(bins) <= max(large, sum(k * n for k, n in counts.items()) / capacity) * 1.25 + 1


def test_shards(odd, odd_rows, nothing, tmp_path):
    got = shard_ids(odd, 3000).collect()
    assert len(got) == len(odd_rows)
    size, rows = Counter(), defaultdict(set)
    for r in got:
        size[r["shard"]] += r["n_bytes"]
        rows[r["shard"]].add(r["doc_id"])
    for r in got:
        assert r["shard_bytes"] == size[r["shard"]] and r["oversized"] == (size[r["shard"]] > 3000)
        assert not r["oversized"] or len(rows[r["shard"]]) == 1
    assert len({d for s in rows.values() for d in s}) == sum(len(s) for s in rows.values())
    assert shard_ids(nothing, 3000).count() == 0
    write_shards(odd.select("doc_id", "text"), 3000, str(tmp_path / "s"))
    assert odd.sparkSession.read.parquet(str(tmp_path / "s")).count() == len(odd_rows)


def test_shards_of_rows_without_id_and_with_clashing_columns(spark, tmp_path):
    docs = spark.createDataFrame([(None, "abc", "s", "i"), (1, "defg", "s", "i"), (None, None, "s", "i")], "doc_id long, text string, shard string, _of_id string")
    ids = write_shards(docs, 5, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert ids.count() == back.count() == 3 and {r["_shard"] for r in back.collect()} == {"s"}
    assert back.filter("doc_id IS NULL").select("shard").distinct().count() == 1


def test_packed_keeps_columns_of_any_name(spark):
    pieces = spark.createDataFrame([(k, 0, 5, "a", "b") for k in range(7)], "doc_id long, piece int, length long, _rank string, `x``y` string")
    out = packed(pieces, 10)
    assert out.columns == [*pieces.columns, "sequence_id", "offset"] and {(r["_rank"], r["x`y"]) for r in out.collect()} == {("a", "b")}
    assert out.select("sequence_id").distinct().count() == 4


def test_batches_are_bounded_by_bytes(spark):
    """Rows of any size reach Python in small batches, a longer row alone; a limit that the session was given stays."""
    import pyarrow as pa

    from tidewell.llm.arrow import BATCH_LIMIT, bounded_batches

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["size", "rows"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    try:
        spark.conf.unset(name)
        bounded_batches(spark)
        texts = spark.range(0, 300, 1, 1).selectExpr("repeat('x', CASE WHEN id = 299 THEN 20000000 ELSE 100000 END) AS text")
        found = texts.mapInArrow(sizes, "size long, rows long").collect()
        assert sum(r["rows"] for r in found) == 300 and all(r["size"] < BATCH_LIMIT + 200_000 for r in found[:-1])
        spark.conf.set(name, "4m")
        bounded_batches(spark)
        assert spark.conf.get(name) == "4m"
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
