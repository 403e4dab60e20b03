"""The prefix trie against brute force over rebuilt conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm.trie import Louds, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            label = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0, label), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    made = {c: own.get(int(c / 20) * 20, [])[: (h := zlib.crc32(str(c).encode()) % 4)] + v[h:] for c, v in own.items()}
    members = defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(made[c]) == len(p))
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def odd_turns():
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 70), 95, 101, 120, 4096 * 3 + 2, 4096 * 3 + 20]:
        hot = rng.random() < 0.4
        for turn in range(rng.randint(1, 9)):
            text = f"opening {turn}  words" if hot and turn < 4 else " ".join(rng.choice("abc") for _ in range(rng.randint(0, 3)))
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", text))
    rows += [(c, t, "user", f"copy {t}") for c in range(200, 260) for t in range(3)]  # exact copies
    rows += [(300, t, "user", f"turn {t % 7} of a long one") for t in range(90)]
    rows += [(303, None, "user", "first"), (303, 0, None, "null role"), (303, 1, "user", None), (303, 1, "user", None), (303, 1, "a", "tie"), (303, 2, "", "x " * 5000)]
    rows += [(None, 0, "user", "no conversation"), (None, None, None, None), (-7, 0, "user", "below zero"), (-20, 0, "user", "b"), (-20, 1, "user", "c")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("shard", "block"), [(4096, 1024), (5, 3), (40, 16)])
def test_against_brute_force(spark, odd_turns, shard, block):
    df = spark.createDataFrame(odd_turns, SCHEMA).repartition(5)
    df = df.withColumns({c: F.lit("clash") for c in ("node", "depth", "label", "length", "nth", "shard", "n")})
    assert found(prefix_trie(df, shard, block)) == brute(odd_turns)


def test_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert found(prefix_trie(rows, 16)) == brute(list(map(tuple, rows.collect())))


def test_empty_and_turnless(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)  # its family's first one is absent
    rows = [(alone, 0, "user", "gone")]
    assert found(prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def test_louds():
    node, parent = np.array([b"b", b"a", b"c", b"d", b"e"], "S32"), np.array([b"a", b"", b"a", b"b", b"x"], "S32")
    trie = Louds(node, parent)
    assert "".join("01"[int(b)] for b in trie.bits) == "110" + "110" + "0" + "10" + "0" + "0"
    assert node[trie.order].tolist() == [b"a", b"e", b"b", b"c", b"d"]
    assert trie.parents().tolist() == [-1, -1, 0, 0, 2]
    assert trie.rolled(np.array([1, 10, 100, 1000, 10000])).tolist() == [11101, 10, 10100, 1000, 10000]
