"""Ranked search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm.lexical import Block, Items, indexed, ranked, ranked_in

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    counted = [(i, Counter(words(t))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in counted]
    n_docs, n_terms = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for _, c in counted for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in dict.fromkeys((i, t or "") for i, t in items):
        found = []
        for (doc, c), n in zip(counted, lengths, strict=True):
            if n:
                m = 10 + 90 * n * n_docs // n_terms
                score = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(words(text)) if c[t])
                if score > 0:
                    found.append((-score, doc is None, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, doc) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def items(odd_rows):
    texts = [t for _, t in odd_rows if t]
    rows = [(k, " ".join(texts[k].split()[3:15])) for k in range(0, 24, 2)]
    return [*rows, (30, None), (31, ""), (32, "a of x zz"), (32, "a of x zz"), (32, "DOIS tres 日本語"), (None, "special one"), (34, "nowhereatall"), (35, texts[-4] * 3)]


@pytest.mark.parametrize("block_bytes", [4 << 20, 3000])
def test_against_brute_force(spark, odd, odd_rows, items, block_bytes):
    rows = [*odd_rows, (None, odd_rows[0][1]), (None, "one"), (7000, "one"), (6000, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({c: F.lit("x") for c in ("block", "items", "item", "score", "rank", "ids", "rows")})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit("clash"))
    index = indexed(docs, block_bytes)
    for item_bytes in (1 << 20, 200):
        assert found(ranked_in(index, bench, docs.schema["doc_id"].dataType, 10, item_bytes)) == brute(rows, items, 10)


def test_many_ties_and_other_ids(spark):
    rng = random.Random(1)
    rows = [(k, "same words here" if k % 3 else rng.choice(["same words", "other words here", "words"])) for k in range(900)]
    rng.shuffle(rows)
    bench = [(0, "words here"), (1, "same"), (2, "other same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(ranked(docs, spark.createDataFrame(bench, "item_id long, text string"), 7)) == brute(rows, bench, 7)
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.format_string("%05d", "doc_id")))
    got = found(ranked(named, spark.createDataFrame([("i", "same")], "item_id string, text string"), 3))
    assert [g[2] for g in got] == [f"d{d:05}" for _, _, d, _ in brute(rows, [(0, "same")], 3)]


def test_empty(spark, nothing):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked(nothing, bench).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert ranked(docs, bench.limit(0)).count() == 0
    assert ranked(docs.filter("doc_id = 2"), bench).count() == 0


def test_bounds_prune(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 40)) for _ in range(60))) for k in range(3000)]
    rows[1234] = (1234, "needle " * 5 + rows[1234][1])
    index = indexed(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    items = Items(["needle a1"])
    block = Block(index[0].asDict(), items, 3000, 180_000)
    best, opened = block.search(items.of[0 : items.at[1]], np.full(len(items.terms), 1000), 1, 1)
    assert best[0][1] == 1234 and opened < 5
