import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tidewell.llm import graph, repeats
from tidewell.llm.arrow import hash_ranges, unzipped
from tidewell.llm.exact import directory, exact_groups, without_copies
from tidewell.llm.near import near_groups, without_near_copies
from tidewell.llm.repeats import LENGTH, without_repeated_bytes
from tidewell.llm.queries import MIN_WORDS
from tidewell.llm.sentences import MIN_SENTENCES, without_repeats
from tidewell.session import written

LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def test_exact(odd, odd_rows, nothing):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for d, t in odd_rows:
        groups[norm(t)].append((-len(t or ""), d))
    got = exact_groups(odd, bucket_hashes=5).collect()
    buckets = defaultdict(set)
    for r in got:
        buckets[r["bucket"], r["depth"]].add(r["text_sha256"])
    assert len(buckets) > 5 and max(map(len, buckets.values())) <= 5
    assert len(got) == len(odd_rows)
    texts = defaultdict(set)
    for d, t in odd_rows:
        texts[d].add(norm(t))
    for r in got:
        (k,) = texts[r["doc_id"]]
        assert (r["keep_id"], r["group_size"]) == (min(groups[k])[1], len(groups[k]))
        assert r["kept"] == (r["doc_id"] == r["keep_id"]) and r["text_sha256"] == hashlib.sha256(k.encode()).hexdigest()
    assert exact_groups(nothing).count() == 0


def test_exact_null_id_and_directory(spark):
    rows = spark.createDataFrame([(None, "a b"), (None, "ab"), (3, "c")], "doc_id long, text string")
    got = exact_groups(rows).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in got) == [("3", "3", 1, True), ("None", "None", 2, True), ("None", "None", 2, True)]
    hashes = spark.range(1000).select(F.xxhash64("id").alias("hash"))
    slots, bits = directory(hashes, 50)
    depths = [r["depth"] for r in slots.collect()]
    assert 4 <= min(depths) and max(depths) <= bits <= 8
    deep = spark.range(40).select(F.col("id").alias("hash")).unionByName(spark.createDataFrame([(-1,), (-(2**62),)], "hash long"))
    assert directory(deep, 4)[1] == 62  # hashes that differ in their last bits only: the directory doubles as often as it takes


def test_without_copies_leaves_one_row_of_each_text(spark):
    rows = [(1, "x y", "a"), (1, "x y", "a"), (1, "xy", "b"), (2, "x  y", "c"), (2, "x  y", "d"), (None, "n", "e"), (None, "n", "e"), (3, None, "f"), (3, "", "g")]
    names = ["doc_id", "text", "a`b.c", "_sha", "_keep_id", "_nth"]
    docs = spark.createDataFrame([(d, t, o, o, o, o) for d, t, o in rows], "doc_id long, text string, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in names[2:]))
    out = without_copies(docs)
    assert out.columns == names
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == [(0, "n"), (2, "x  y"), (3, "")]
    near = without_near_copies(docs)
    assert near.columns == names and near.count() == 4


def test_without_copies_keeps_columns(odd):
    out = without_copies(odd)
    assert out.columns == odd.columns
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert 100 not in ids and 7 in ids and {500, 501, 502} & set(ids) == {502}


def shingles(text, size):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOW))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


@pytest.mark.parametrize("size", [4, 5])
def test_near(odd, odd_rows, nothing, size):
    sets = {d: shingles(t, size) for d, t in odd_rows}
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = near_groups(odd, size, 80).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        d = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[d]), find(d), find(d) == d)
    assert near_groups(nothing).count() == 0


def test_near_rows_without_id(spark):
    rows = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in near_groups(rows).collect())
    assert got == [("1", "1", True), ("2", "2", True), ("None", "None", True)]
    assert without_near_copies(rows).count() == 3


def test_near_group_with_many_components(spark):
    """Copies that drift apart: links only between neighbours, one group under the keys."""
    words = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(60):
        words = [*words[:5 * k], *(f"x{k}.{j}" for j in range(5)), *words[5 * k + 5 :]][:300]
        rows.append((k, " ".join(words)))
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80)
    assert {r["component_id"] for r in got.collect()} == {0}


def test_near_texts_under_one_id(spark):
    """Different texts under one doc_id are linked by it, so what is near either of them is one group."""
    a, b = ([f"{c}{i}" for i in range(60)] for c in "ab")
    near = lambda words: " ".join([*words[:-1], "zz"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (2, near(a)), (3, near(b)), (4, "other words than those"), (4, None), (4, ""), (6, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in near_groups(docs, 4).collect())
    assert got == [(2, 2), (3, 2), (4, 4), (4, 4), (4, 4), (5, 2), (5, 2), (6, 6)]
    out = without_near_copies(docs.unionByName(docs), 4).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in out) == [(2, near(a)), (4, ""), (4, "other words than those"), (6, "alone")]


def test_near_template_pages(spark):
    """Pages of which four fifths are alike, short of the bound: no pair of them is compared; two that are near enough are found."""
    from tidewell.llm import near

    pages = {k: " ".join([*(f"t{i}" for i in range(78)), *(f"p{k}.{i}" for i in range(22))]) for k in range(300)}
    pages[400] = pages[299] + " end"
    docs = spark.createDataFrame(list(pages.items()), "doc_id long, text string")
    every = written(near.profiles(docs, 4), "profiles")
    ids = every.select(F.col("set").alias("id"))
    texts = every.select("doc_id", "set").join(docs, "doc_id").select("set", "text")
    least = ids.agg(F.min("id")).first()[0]
    groups = ids.withColumn("label", F.struct(F.lit(least["k1"]).alias("k1"), F.lit(least["k2"]).alias("k2")))
    left = near.pairs_left(groups, groups.limit(0), texts, 4, 80)
    assert left.count() == 1 and near.confirmed(left, texts, 4, 80).count() == 1


def test_near_pairs_left_are_compared_in_tiles(spark, monkeypatch):
    """One group of 60 texts, all pairs of which are left: links are those of brute force, and no join makes a row for each pair."""
    from tidewell.llm import near

    rng, words = random.Random(3), [f"t{i}" for i in range(100)]
    texts = [(k, " ".join(f"c{k}.{i}" if rng.random() < 0.025 else w for i, w in enumerate(words))) for k in range(60)]
    sets = {k: {tuple(t.split(" ")[i : i + 4]) for i in range(97)} for k, t in texts}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert 100 < len(want) < 1700
    rows = spark.createDataFrame(texts, "set long, text string")
    ids = spark.range(60)
    sizes = []
    monkeypatch.setattr(near, "written", lambda df, label: sizes.append((label, df.count())) or written(df, label))
    for n, tiles in ((256, 1), (20, 9)):
        monkeypatch.setattr(near, "BLOCK_TEXTS", n)
        left = near.pairs_left(ids.withColumn("label", F.lit(0).cast("long")), ids.select("id", F.col("id").alias("label")).limit(0), rows, 4, 80)
        pairs = {(r["a"], r["b"]) for r in left.collect()}
        assert {tuple(sorted(p)) for p in pairs} >= want
        got = near.confirmed_in_tiles(left, rows, 4, 80).collect()
        assert len(got) == len(want) and {tuple(sorted((r["a"], r["b"]))) for r in got} == want
        assert left.select("group", "block", "block_b").distinct().count() == tiles
        assert dict(sizes)["tiles"] <= 60 * tiles ** 0.5 < len(pairs) / 3
    nothing = near.confirmed_in_tiles(left.limit(0), rows, 4, 80)
    assert nothing.columns == ["a", "b"] and nothing.count() == 0


def sentences_of(text):
    """Pieces, each with its words."""
    return [(p, tuple(re.findall(rb"[0-9a-z\x80-\xff]+", p.encode().translate(LOW)))) for p in re.findall(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+", text or "")]


def removed_by_every_run(docs, min_words=0):
    """Sentences that a repeated run of any length covers, by document."""
    seen, gone = set(), defaultdict(set)
    for d in sorted(docs):
        s = [w for _, w in docs[d] if w]
        for i in range(len(s)):
            for j in range(i + MIN_SENTENCES, len(s) + 1):
                if sum(map(len, s[i:j])) >= min_words:
                    run = tuple(s[i:j])
                    gone[d].update(range(i, j) if run in seen else ())
                    seen.add(run)
    return gone


def test_sentences(odd, odd_rows, nothing):
    """Runs of every length by brute force."""
    docs = {d: sentences_of(t) for d, t in odd_rows if d != 507}
    gone = removed_by_every_run(docs)
    got = without_repeats(odd.filter("doc_id <> 507")).collect()
    assert len(got) == len(odd_rows) - 1
    for r in got:
        k, kept, n = -1, "", 0
        for p, w in docs[r["doc_id"]]:
            k += bool(w)
            n += bool(w)
            if not (w and k in gone[r["doc_id"]]):
                kept += p
        assert (r["doc_id"], r["n_sentences"], r["n_removed"], r["kept_text"]) == (r["doc_id"], n, len(gone[r["doc_id"]]), kept)
    assert any(r["n_removed"] for r in got) and without_repeats(nothing).count() == 0


def test_short_runs_and_rows_without_id(spark):
    """Eleven words in two sentences are enough; a row without a doc_id comes first."""
    same = "One two three four five. Six seven eight nine ten eleven."
    rows = [(1, f"{same} Alpha beta."), (2, f"{same} Gamma delta."), (None, f"Epsilon. {same}"), (3, "One two. Three four five six seven. Eight.")]
    got = {r["doc_id"]: r["n_removed"] for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {None: 0, 1: 2, 2: 2, 3: 0}


def test_every_run_reaches_the_end_of_a_passage(spark, odd, odd_rows):
    """All runs, of any number of sentences, by brute force: what an earlier one equals is gone."""
    say = lambda name, *sizes: " ".join(" ".join(f"{name}{i}w{j}" for j in range(n)) + "." for i, n in enumerate(sizes))
    passage = say("s", 12, 9, 7)
    rows = [(k, f"{say(f'a{k}', 15, 15)} {passage} {say(f'b{k}', 15, 15)}") for k in range(3)] + [(k, f"{say(f'c{k}', 15, 15)} {passage}") for k in (3, 4)]
    got = {r["doc_id"]: (r["n_sentences"], r["n_removed"]) for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), MIN_WORDS).collect()}
    assert got == {0: (7, 0), 1: (7, 3), 2: (7, 3), 3: (5, 3), 4: (5, 3)}
    docs = {d: sentences_of(t) for d, t in odd_rows if d != 507}
    gone = removed_by_every_run(docs, MIN_WORDS)
    got = {r["doc_id"]: r["n_removed"] for r in without_repeats(odd.filter("doc_id <> 507"), MIN_WORDS).collect()}
    assert got == {d: len(gone[d]) for d in docs}


def test_repeated_bytes(odd, odd_rows, nothing):
    texts = [(d, (t or "").encode()) for d, t in odd_rows]
    count = Counter(t[i : i + LENGTH] for _, t in texts for i in range(len(t) - LENGTH + 1))
    want = Counter()
    for d, t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - LENGTH + 1):
            if count[t[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = [True] * LENGTH
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        want[d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in without_repeated_bytes(odd).collect())
    assert got == want
    assert without_repeated_bytes(nothing).count() == 0


def test_hot_anchors(spark, odd, odd_rows, nothing, monkeypatch):
    """A line of many documents, each time in other surroundings: its anchors' entries don't meet in one group, and the bytes are the same."""
    monkeypatch.setattr(repeats, "HOT", 20)
    rng = random.Random(3)
    line = prose(rng, 40)[:150]
    rows = [(k, f"{prose(rng, 40)}{line}{prose(rng, 40)}") for k in range(60)]
    rows += [(100 + k, f"{t[80:]} {t[:80]}") for k, (_, t) in enumerate(rows[:5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    blocks = written(repeats.text_blocks(docs), "blocks")
    first, _, n_hot = repeats.repeated_anchors(blocks)
    groups = Counter()
    for r in repeats.shard_entries(blocks, first, 2).collect():
        groups.update(repeats._hashes(unzipped(r["entries"], np.uint8).reshape(-1, repeats.ENTRY)).tolist())
    assert max(groups.values(), default=0) <= 20 and n_hot >= 40
    test_repeated_bytes(docs, rows, nothing)
    monkeypatch.setattr(repeats, "HOT", 1)
    monkeypatch.setattr(repeats, "RANGE_WINDOWS", 50_000)
    test_repeated_bytes(odd, odd_rows, nothing)


def test_interleave_of_sorted_shards():
    """Merged by runs alone, the shards' orders give the order of all, and common prefixes to the byte."""
    rng = np.random.default_rng(4)
    rows = rng.choice([0, 1, 97], (400, 24), p=[0.1, 0.1, 0.8]).astype(np.uint8)
    rows[200:260] = rows[:60]
    rows[:, :8] = rng.integers(0, 3, 400)[:, None]
    cuts = [0, 0, 130, 131, 400]
    shards = [sorted(map(bytes, rows[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    flat = [x for shard in shards for x in shard]
    words = np.frombuffer(b"".join(flat), ">u8").reshape(-1, 3).T.astype(np.uint64)
    order, common = repeats.interleaved(words, np.array(cuts))
    merged = [flat[k] for k in order]
    assert merged == sorted(flat) and sorted(order.tolist()) == list(range(400))
    for a, b, n in zip(merged[:-1], merged[1:], common[1:].tolist(), strict=True):
        alike = next((k for k in range(24) if a[k] != b[k]), 24)
        assert n == (alike - 8 if a[:8] == b[:8] else -1)


def test_sentences_of_rows_under_one_id(spark):
    """Rows of one id whose words are cut otherwise are documents of their own; nothing of one is taken from another."""
    rows = [(0, "A b. C d. E f."), (1, "A b. C d. E f."), (1, "A b C d. E f."), (2, "zz."), (3, "A b C d. E f.")]
    got = sorted((r["doc_id"], r["n_removed"], r["kept_text"]) for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect())
    assert got == [(0, 0, "A b. C d. E f."), (1, 0, "A b C d. E f."), (1, 3, ""), (2, 0, "zz."), (3, 2, "")]


def test_sentences_of_a_long_text(odd, odd_rows):
    """Runs of two stand for all, so the long text is held against those."""
    docs, seen, gone = {d: [w for _, w in sentences_of(t) if w] for d, t in odd_rows}, set(), defaultdict(set)
    for d in sorted(docs):
        for i, run in enumerate(zip(docs[d], docs[d][1:], strict=False)):
            gone[d].update((i, i + 1) if run in seen else ())
            seen.add(run)
    assert {r["doc_id"]: (r["n_sentences"], r["n_removed"]) for r in without_repeats(odd).collect()} == {d: (len(s), len(gone[d])) for d, s in docs.items()}


def test_copies_with_ids_of_any_type(spark, odd):
    named = odd.withColumn("doc_id", F.concat(F.lit("d"), F.format_string("%04d", "doc_id")))
    plain, got = ({(str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in exact_groups(d).collect()} for d in (odd, named))
    assert got == {(f"d{int(d):04}", f"d{int(k):04}", n, kept) for d, k, n, kept in plain}
    assert without_copies(named).count() == without_copies(odd).count()


def test_ranges_of_hashes():
    hashes = np.sort(np.random.default_rng(3).integers(0, 2**64, 1000, dtype=np.uint64))
    for ranges in (1, 7, 1000, 4_000_000):
        found = hash_ranges(hashes, ranges)
        assert [(a, b) for _, a, b in found][0][0] == 0 and found[-1][2] == 1000 and all(x[2] == y[1] and x[0] < y[0] for x, y in zip(found[:-1], found[1:], strict=True))
        assert all((int(h) >> 32) * ranges >> 32 == part for part, a, b in found for h in hashes[a:b])
    assert hash_ranges(hashes[:0], 5) == []


def test_components(spark, monkeypatch):
    """Chains in any order, stars, a clique, loops and no edge at all; edges inside what has grown together are looked at once."""
    rng = random.Random(8)
    ids = list(range(400))
    rng.shuffle(ids)
    edges = list(zip(ids[:99], ids[1:100], strict=True)) + [(a, a + 1) for a in range(1000, 1100)] + [(2050, a) for a in range(2000, 2100)]
    edges += [(a, b) for a in range(3000, 3060) for b in range(3000, 3060) if a != b] + [(4000, 4000)] + [(rng.choice(ids[100:]), rng.choice(ids[100:])) for _ in range(250)]
    parent = {i: i for e in edges for i in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    sizes = []

    def counted(df, label):
        out = written(df, label)
        sizes.extend([out.count()] if label == "edges" else [])
        return out

    monkeypatch.setattr(graph, "written", counted)
    got = {r["id"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in parent}
    assert sizes[0] == len({tuple(sorted(e)) for e in edges}) and sum(sizes[1:]) < sizes[0] / 4
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
