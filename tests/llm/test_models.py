import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import decontaminate
from tidewell.llm.decontaminate import contamination, cut, decontaminated, words_of
from tidewell.llm.lm import lm_scores
from tidewell.llm.queries import QUERIES
from tidewell.llm.toxicity import held_out, model_of, scored, without_toxic
from tests.llm.test_dedup import LOW

SF = "/root/testdata/sf0.01"


def hits(text, items, window):
    w = words_of(text)
    hit, found = set(), set()
    for i, t in items:
        v = words_of(t)
        k = min(window, len(v))
        wins = {tuple(v[p : p + k]) for p in range(len(v) - k + 1)} if v else set()
        for p in range(len(w) - k + 1):
            if tuple(w[p : p + k]) in wins:
                hit.update(range(p, p + k))
                found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("round_bytes", [1 << 20, 100])
def test_contamination(spark, odd, odd_rows, nothing, monkeypatch, round_bytes):
    monkeypatch.setattr(decontaminate, "ROUND_BYTES", round_bytes)
    by_id = dict(odd_rows)
    items = [(1, by_id[3]), (2, " ".join(words.decode() for words in words_of(by_id[5])[4:20]).upper()), (3, "one"), (4, None), (5, ""), (6, "dois tres"), (7, by_id[3]), (8, "never seen words here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(odd, bench, 10).collect()
    assert len(got) == len(odd_rows)
    import hashlib

    for r in got:
        n, hit, found = hits(by_id[r["doc_id"]], items, 10)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(found), hit > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
    null = spark.createDataFrame([(None, by_id[3]), (5, by_id[3])], "item_id long, text string")
    assert {(r["n_items"], r["items_sha256"]) for r in contamination(odd, null, 10).filter("doc_id = 3").collect()} == {(2, hashlib.sha256(b",5").hexdigest())}
    assert contamination(nothing, bench, 10).count() == 0
    assert not any(r["contaminated"] for r in contamination(odd, bench.limit(0), 10).collect())


def test_decontaminated(spark):
    item = " ".join(f"w{i}" for i in range(12))
    rows = [(1, "clean text", 10), (2, f"{' '.join('abc' for _ in range(40))}, {item}! end", 99), (3, item, 9), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = {r["doc_id"]: r for r in decontaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(out) == {1, 2, 4} and out[1]["n_chars"] == 10
    assert "w3" not in out[2]["text"] and out[2]["text"].endswith("! end") and out[2]["n_chars"] == len(out[2]["text"])
    assert cut("a b c d", [(0, 1), (2, 4)]) == " \ufffc  b  \ufffc "


def test_decontaminated_makes_no_window_at_seams(spark):
    """Half a window, a whole one, and the other half: what is left of the text has no window."""
    item, other = ([f"{c}{i}" for i in range(10)] for c in "vw")
    rest = [f"r{i}" for i in range(30)]
    rows = [(1, " ".join([*item[:5], *other, *item[5:], *rest]), 1, "x", "y"), (2, None, 2, None, None), (2, None, 2, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _tw_spans int, `a``b` string, _TW_items string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other))], "item_id long, text string")
    out = decontaminated(docs, bench)
    assert out.columns == docs.columns and sorted(r["_tw_spans"] for r in out.collect()) == [1, 2, 2]
    assert contamination(out, bench).filter("contaminated").isEmpty() and "v0" in out.filter("doc_id = 1").first()["text"]
    assert decontaminated(docs.limit(0), bench).count() == 0 and decontaminated(docs, bench.limit(0)).count() == 3


def test_language_model(odd, odd_rows, nothing):
    tokens = [(d, [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOW)), None]) for d, t in odd_rows]
    out = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    c = Counter(w for d, ws in tokens if not out(d) for w in ws)
    n, v = c.total(), len(c)
    want = {d: (len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for d, ws in tokens}
    got = lm_scores(odd, ~held_out(F.col("doc_id"), 5, 1)).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        a, b, k, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (a, b, k)
        assert abs(r["base_score"] - base) < 1e-9 * abs(base) + 1e-9 and -1e6 < r["score"] < 0
    assert lm_scores(nothing, F.lit(True)).count() == 0
    assert {r["n_known"] for r in lm_scores(odd, F.lit(False)).collect()} == {0}


def test_language_model_scores_by_brute_force(spark, odd, odd_rows):
    """Scores token by token from the weights, as plain sums over words; and probabilities of all words, unknown ones as one in each class, add up to one."""
    import numpy as np

    from tidewell.llm import lm

    train = ~held_out(F.col("doc_id"), 5, 1)
    blocks = lm.coded_blocks(odd, train)
    found = lm.word_counts(blocks, 1000)
    model = lm.trained(blocks, found, 8)
    assert any(w[:-32].any() for w in model.weights)
    out = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    texts = {d: (t or "").encode() for d, t in odd_rows}
    ids = {d: lm.word_ids(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].tolist() for d, t in texts.items()}
    counts = Counter(w for d, _ in odd_rows if not out(d) for w in ids[d])
    by_class = {k: sorted((w for w in counts if w % 32 == k), key=lambda w: (-counts[w], w - 2**64 * (w >= 2**63))) for k in range(32)}

    def logsoftmax(row, i):
        return row[i] - math.log(sum(math.exp(x) for x in row))

    def log10(seen, w):
        before = (seen[::-1] + [0, 0, 0])[:3]
        kinds = [x % 32 + 1 if k < len(seen) else 0 for k, x in enumerate(before)]
        b = model.buckets
        mix = lambda x: int(lm.mixed(np.array([x % 2**64], np.uint64))[0])
        at = lambda x, salt: mix(x + salt * 0x9E3779B97F4A7C15) % b
        kind, own = w % 32, by_class[w % 32][:7]
        first = sum(model.weights[0][r].astype(float) for r in (at(before[0], 1), b + at(kinds[0] * 33 + kinds[1], 2), 2 * b + at(kinds[1] * 33 + kinds[2], 3), 3 * b))
        second = sum(model.weights[1][r].astype(float) for r in (at(mix(before[0]) + kind, 4), b + at(mix(before[1]) + kind, 5), 2 * b + kind))
        share = 0.0
        if w not in own:
            rest = by_class[kind][7:]
            share = math.log((counts[w] + 0.5) / (sum(counts[x] for x in rest) + 0.5 * (len(rest) + 1)))
        return (logsoftmax(first, kind) + logsoftmax(second, own.index(w) if w in own else 7) + share) / math.log(10)

    got = {r["doc_id"]: r["score"] for r in lm.scores(odd, blocks, found, model).collect()}
    for d in (0, 3, 303, 400, 500, 503, 510):
        want = sum(log10(ids[d][:k], w) for k, w in enumerate(ids[d]))
        assert abs(want - got[d]) < 2e-4 * abs(want) + 1e-4
    every = [w for k in range(32) for w in [*by_class[k], next(x for x in range(10**6 * 32 + k, 10**8, 32) if x not in counts)]]
    assert abs(sum(10 ** log10(ids[3][:5], w) for w in every) - 1) < 1e-4


def test_language_model_counts_over_blocks_and_groups(spark, odd, odd_rows, nothing, monkeypatch):
    """Many blocks, groups and ranges give the same counts; the long text is a block of its own."""
    from tidewell.llm import lm

    real = lm.text_slices
    monkeypatch.setattr(lm, "RANGE_WORDS", 700)
    monkeypatch.setattr(lm, "text_slices", lambda batches, limit: real(batches, limit=2000))
    groups = lm.coded_blocks(odd, F.lit(True)).groupBy("group").count().collect()
    assert len(groups) > 3 and max(r["count"] for r in groups) == lm.GROUP_BLOCKS
    test_language_model(odd, odd_rows, nothing)


def test_language_model_beats_unigrams_on_held_out_texts(spark):
    out = QUERIES["op9_lm"](spark, SF).filter("held_out").agg(F.sum("n_tokens").alias("n"), F.sum("base_score").alias("base"), F.sum("score").alias("score")).first()
    assert out["score"] > out["base"] + 0.1 * out["n"]


def test_toxicity_on_held_out_texts(spark):
    """A fifth of the labels of these 400 texts are noise; the words themselves are found."""
    found = QUERIES["op8_toxicity"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = found.join(labels, "doc_id").filter("held_out").collect()
    caught = sum(r["predicted"] and r["toxic"] for r in rows)
    assert caught >= 0.55 * sum(r["toxic"] for r in rows) and caught >= 0.8 * sum(r["predicted"] for r in rows)
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_toxicity_edge_cases(spark, odd, odd_rows, nothing):
    labels = spark.createDataFrame([(i, 1 if i % 2 else 0) for i in range(20)] + [(None, 1), (3, None), (99999, 1)], "doc_id long, toxic int")
    odd = odd.withColumns({"_toxicity": F.lit("clash"), "a`b.c": F.lit("clash")})
    found, name = scored(odd, model_of(odd, labels))
    got = found.collect()
    assert found.columns == [*odd.columns, name] and {r["_toxicity"] for r in got} == {"clash"}
    assert len(got) == len(odd_rows) and all(0 <= r[name] <= 1 for r in got)
    assert len({r[name] for r in got if r["doc_id"] in (500, 501, 502)}) == 1
    assert all(len({r[name] for r in got if r["doc_id"] in (i, 100 + i)}) == 1 for i in range(6))
    assert scored(nothing, model_of(odd, labels))[0].count() == 0
    empty = model_of(odd, labels.limit(0))
    assert not empty.weights.any() and empty.shares[-1] < 0
    assert without_toxic(odd, labels.limit(0)).columns == odd.columns


def test_parts_of_long_texts_are_learned_from(spark, monkeypatch):
    """A labelled text above the bound is in the sample by some of its parts."""
    from tidewell.llm import toxicity

    monkeypatch.setattr(toxicity, "PART_CHARS", 40)
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(60 if k % 2 else 3)), k % 3 == 0) for k in range(12)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(y)) for k, _, y in rows], "doc_id long, toxic int")
    frames = []
    monkeypatch.setattr(type(docs), "repartition", lambda df, n: frames.append(df) or df.coalesce(n))
    model_of(docs, labels)
    seen = {r["doc_id"]: r["text"] for r in frames[0].collect()}
    assert set(seen) == set(range(12)) and all(seen[k] == t if k % 2 == 0 else len(seen[k]) == 81 for k, t, _ in rows)
    assert all(part in rows[1][1] for part in (seen[1][:40], seen[1][41:]))


def test_unseen_misspellings():
    from tidewell.llm.toxicity import Windows, train

    rng = np.random.default_rng(1)
    clean = lambda: " ".join("".join(rng.choice(list("aeioutnrs"), 5)) for _ in range(40))
    texts = [clean() for _ in range(300)]
    labels = [int(i % 4 == 0) for i in range(300)]
    texts = [t + f" {['wretched', 'wretchedly'][i % 8 == 0]} " + clean() if y else t for i, (t, y) in enumerate(zip(texts, labels, strict=True))]
    model = train(texts, labels)
    raw = [s.encode() for s in (clean() + " wretchd " + clean(), clean() + clean())]
    bad, good = model.logits(Windows(np.frombuffer(b"".join(raw), np.uint8), np.array([0, len(raw[0]), len(raw[0]) + len(raw[1])])))
    assert bad > 0 > good


def test_whole_bag_is_the_mean_over_all_words():
    from tidewell.llm.toxicity import BUCKETS, Windows

    texts = [b"", b"one two three two", b"...", b"two"]
    w = Windows(np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])))
    weights = np.random.default_rng(1).normal(size=BUCKETS).astype(np.float32)
    of = {w.words[k].as_py(): weights[w.buckets[w.edges[k] : w.edges[k + 1]]] for k in range(len(w.words))}
    want = [0, np.concatenate([of[x] for x in texts[1].split()]).mean(), 0, of[b"two"].mean()]
    assert np.allclose(w.whole(weights), want, atol=1e-6)


def test_every_pair_of_words_is_a_window():
    """A word put in front of a text takes no pair from it."""
    from tidewell.llm.toxicity import BUCKETS, Windows

    texts = [b"", b"one", b"a long bad word here", b"so a long bad word here", b"bad word"]
    w = Windows(np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])))
    words = [w.words[int(c)].as_py() for c in w.code]
    found = [[b" ".join(words[a:b]) for a, b in zip(w.first[i:j], w.last[i:j], strict=True)] for i, j in zip(w.text_at[:-1], w.text_at[1:], strict=True)]
    pairs = [b"a long", b"long bad", b"bad word", b"word here"]
    assert found == [[], [b"one"], pairs, [b"so a", *pairs], [b"bad word"]]
    z = w.logits(np.random.default_rng(1).normal(size=BUCKETS).astype(np.float32))
    assert z[1:5].tolist() == z[6:10].tolist() and z[3] == z[10]


def test_many_parts_of_items_read_the_documents_once(spark, monkeypatch):
    """Items of several automata: one written copy of the documents, and the results of one automaton."""
    from tidewell.llm import decontaminate

    rng = np.random.default_rng(2)
    text = lambda n: " ".join("".join(rng.choice(list("abcdef"), 2)) for _ in range(n))
    items = [(k, text(int(rng.integers(1, 25)))) for k in range(60)]
    rows = [(k, f"{text(30)} {items[k % 60][1]} {text(20)}" if k % 3 else text(200)) for k in range(150)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, contamination(docs, bench).collect()))
    labels = []
    monkeypatch.setattr(decontaminate, "ROUND_BYTES", 200)
    monkeypatch.setattr(decontaminate, "written", lambda df, label, w=decontaminate.written: labels.append(label) or w(df, label))
    assert sorted(map(tuple, contamination(docs, bench).collect())) == want
    assert labels.count("stretches") == 1 and labels.count("stretch-hits") > 5
    out, whole = (sorted(map(tuple, d.collect())) for d in (decontaminated(docs, bench), docs.filter("doc_id < 0")))
    monkeypatch.setattr(decontaminate, "ROUND_BYTES", 1 << 20)
    assert out == sorted(map(tuple, decontaminated(docs, bench).collect())) and not whole


def test_toxicity_scores_by_brute_force(spark, odd, odd_rows):
    """Scores from the model's weights, word by word; of a text above a slice too."""
    from tidewell.llm.toxicity import WINDOW, Windows

    labels = spark.createDataFrame([(i, 1 if i % 2 else 0) for i in range(20)], "doc_id long, toxic int")
    model = model_of(odd, labels)
    rows = [*odd_rows[:20], (900, None), (901, "one"), (902, "x y z " * 60_000 + "tail")]

    def logit(text):
        words = words_of(text)
        of = {}
        for w in set(words):
            coded = Windows(np.frombuffer(w, np.uint8), np.array([0, len(w)]))
            of[w] = model.weights[coded.buckets].astype(np.float64)
        bags = [np.concatenate([of[w] for w in words[k : k + WINDOW]]).mean() for k in range(max(1, len(words) - WINDOW + 1))] if words else []
        total, size = sum(of[w].sum() for w in words), sum(len(of[w]) for w in words)
        return np.dot(model.shares, [max(bags, default=0), total / size if size else 0, min(math.log1p(len(bags)), model.longest), 1])

    found, name = scored(spark.createDataFrame(rows, "doc_id long, text string"), model)
    got = {r["doc_id"]: r[name] for r in found.collect()}
    for d, t in rows:
        assert abs(got[d] - 1 / (1 + math.exp(-logit(t)))) < 1e-4


def test_stages_on_empty_tables_and_odd_rows(spark, odd, nothing):
    """Each stage on no rows and on odd ones: columns stay, rows are of the ones given."""
    import corpus_pipeline

    for docs in (nothing, odd):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            if name != "packing":
                assert out.columns == docs.columns
                assert out.select("doc_id", "lang").exceptAll(docs.select("doc_id", "lang")).isEmpty()
            else:
                assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
