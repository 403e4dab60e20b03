import random

import pytest


def prose(rng, n, letters="abcdefghijklmnopqrstuvwxyzé"):
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n)]
    return " ".join(w + rng.choice(["", "", "", ".", ",", "!\n"]) for w in words)


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text) with nulls, empty and long texts, copies, near copies, repeated rows and repeated passages."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(30, 160)) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t) for i, t in enumerate(base[:6])]  # exact copies
    rows += [(200 + i, t.replace(" ", "\t", 3)) for i, t in enumerate(base[:4])]  # equal but for blanks
    for i in range(12):  # near copies of one text, in a chain of changes
        words = base[7].split(" ")
        for _ in range(i):
            words[rng.randrange(len(words))] = "zz"
        rows.append((300 + i, " ".join(words)))
    passage = prose(rng, 60)
    rows += [(400 + i, prose(rng, 20) + "\n" + passage + "\n" + prose(rng, 20)) for i in range(5)]
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "one"), (504, "Um dois tres"), (505, "." * 300), (506, "a" * 500), (507, prose(rng, 6000)), (508, "x " * 2000)]
    rows += [(509, "<|endoftext|> special <|endoftext|>x  two  spaces\n\n don't stop 　 日本語 テスト 🙂🙂 123 4567 é é"), (510, "É DIFÍCIL Ünder")]
    rows += [rows[0], rows[0], rows[2]]  # repeated rows
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows with other columns, some named as the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit("clash") for c in ("lang", "hash", "norm", "id", "key", "label", "n", "words", "train", "piece", "text_key")}).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
