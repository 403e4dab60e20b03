"""Discharge pages against the rules of S08 word by word, and the plan of the query on them."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from tests.compare import connect, same
from tests.test_findings import tables
from tests.test_oracle import QUERIES, SQL
from tidewell.sources.discharges import DATE, DOCTOR, PREFIX, RECORD, WORDS, _cut, discharged_patients

S08 = "s08_discharged_patients"


def patients(words):
    """Of one page's words (x, y, text), one after the other."""
    like = lambda pattern, word: re.fullmatch(pattern[1:-1], word)
    begins = []
    for x in sorted({x for x, _, t in words if like(RECORD, t)}):
        if not begins or x - begins[-1] > 1.5:
            begins.append(x)
    for band, begin in enumerate(begins):
        column = lambda second: [t for _, t in sorted((-y, t) for x, y, t in words if (abs(x - begin) >= 1.0 and abs(x - begin - 1.0) < 1.0 if second else abs(x - begin) < 1.0))]  # noqa: B023, E731
        main, beside = column(False), list(dict.fromkeys(t for t in column(True) if not like(DATE, t)))
        record = main.pop(0) if like(RECORD, main[0]) else ""
        while main and like(PREFIX, main[0]):
            main.pop(0)
        doctor = next((k for k, t in enumerate(main) if like(DOCTOR, t)), None)
        day = next((t for t in main[doctor + 1 :] if like(DATE, t)), "") if doctor is not None else ""
        one = beside[0] if beside else ""
        special = len(beside) == 1 and 2 <= len(one) <= 4 and one.isalpha() and one.isupper()
        name = main[:doctor]
        if record or name:
            yield band, re.sub(r"\D", "", record), " ".join(name).strip(), "" if special else one, one if special else beside[-1] if len(beside) > 1 else "", day[:6] + "20" + day[6:] if len(day) == 8 else day


def test_pages_as_word_by_word(spark):
    """Records so near each other that bands' words overlap, chains of records of many bands, equal places, words that have no place or text."""
    rnd = random.Random(8)
    kinds = ["123/4", "77/2", "A", "BC", "ANA", "José", "12345", "CRMba", "01/02/24", "03/04/2025", "UN08", "CLM", "x1"]
    page = lambda wide, n: [(round(rnd.randrange(10 * wide) / 10, 1), float(rnd.randrange(12)), rnd.choice(kinds)) for _ in range(n)]
    pages = {f"p{k}": page(*size) for k, size in enumerate([(3, 12), (8, 40), (30, 60), (100, 60), (600, 3000), (9, 0)] * 3)}
    pages["chain"] = [(round(k * 0.7, 1), 1.0, "123/4") for k in range(640)]
    rows = [(p, *w) for p, words in pages.items() for w in words]
    rows += [("p1", None, 1.0, "123/4"), ("p2", float("nan"), 1.0, "123/4"), ("p3", 1.0, 1.0, None), ("p4", float("inf"), 1.0, "ANA"), (None, 1.0, 1.0, "123/4")]
    rnd.shuffle(rows)
    out = discharged_patients(spark.createDataFrame(rows, "page string, x double, y double, text string")).collect()
    assert sorted(map(tuple, out)) == sorted((p, *row) for p, words in pages.items() for row in patients(words))


def test_line_breaks_at_ends_of_words(spark, tmp_path):
    texts = ["a AB\n c 12345 e 01/02/24\n g AB\nx h 123456\n i j", "a A\r\n c d e f g BC\n i 4444\n k l m n o CRM\n q r", "", " ", "\n", "a  b\n\nc\n", None]
    documents = spark.createDataFrame([(11 + k // 2 * 10 + k % 2, t) for k, t in enumerate(texts)], "doc_id long, text string")
    sf_dir = tables(spark, tmp_path, documents=documents)
    assert same(QUERIES[S08](spark, sf_dir), connect(sf_dir), SQL[S08]) is None


def test_words_are_not_shuffled(spark):
    """Documents are dealt out once, as texts; their words are neither shuffled nor joined."""
    plan = QUERIES[S08](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    full = QUERIES[S08](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert full.count("Exchange ") == 1 and "Exchange hashpartitioning(doc_id" in full
    assert not re.search("Join|Window|UDTF", plan)


def test_a_long_page(spark):
    """300,000 words of one page, in 50,000 bands."""
    band = [(0.0, 100.0, "101/1"), (0.1, 99.0, "ANA"), (0.2, 98.0, "12345"), (0.3, 97.0, "01/02/24"), (1.1, 90.0, "CLM"), (1.2, 95.0, "L1")]
    word = F.explode(F.array(*[F.struct((F.col("id") * 5.0 + x).alias("x"), F.lit(y).alias("y"), F.lit(t).alias("text")) for x, y, t in band])).alias("w")
    out = discharged_patients(spark.range(50_000).select(F.lit(1).alias("page"), word).select("page", "w.*"))
    assert [tuple(r) for r in out.groupBy(*out.columns[2:]).agg(F.count("*"), F.countDistinct("band")).collect()] == [("1011", "ANA", "L1", "CLM", "01/02/2024", 50_000, 50_000)]


def test_batches_of_many_words():
    """Pages are taken together up to a number of words; empty pages, and pages of none, lie between."""
    kinds, n = ([0.0, 0.1, 1.2, 9.0], [3.0, 2.0, 1.0, 9.0], ["123/4", "ANA", "L1", "77/2"]), WORDS // 4 + 1000
    lists = [pa.array([None if k % 1000 == 7 else [] if k % 1000 == 8 else values for k in range(n)]) for values in kinds]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), *lists], ["page", "x", "y", "text"])
    parts = list(_cut(iter([batch, batch.slice(0, 0), batch.slice(7, 1)])))
    found = pa.Table.from_batches(parts).to_pydict()
    pages = [k for k in range(n) if k % 1000 not in (7, 8)]
    assert len(parts) == 3 and found["page"] == [k for k in pages for _ in range(2)] and found["band"] == [0, 1] * len(pages)
    assert set(zip(found["record"], found["name"], found["day"], found["beside"], found["last"])) == {("123/4", "ANA", None, "L1", None), ("77/2", "", None, None, None)}
