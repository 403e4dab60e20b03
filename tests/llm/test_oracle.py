"""The registered queries against their SQL, and the pipeline's stages against the operators' own rules."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import connect, same
from tidewell.llm.decontaminate import contamination
from tidewell.llm.exact import exact_groups
from tidewell.llm.near import near_groups
from tidewell.llm.queries import QUERIES, SQL
from tidewell.session import written

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    con = connect(SF)
    con.sql("SET memory_limit = '6GB'")
    assert same(QUERIES[name](spark, SF), con, SQL[name]) is None


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == before.columns
            assert docs.select("doc_id").exceptAll(before.select("doc_id")).isEmpty()
            kept[name] = docs.count()
        if name == "exact_dedup":
            assert exact_groups(docs).filter("NOT kept").isEmpty()
            assert docs.count() == exact_groups(before).filter("kept").count()
        if name == "near_dedup":
            assert docs.count() == near_groups(before).filter("kept").count()
        if name == "decontamination":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert contamination(docs, bench).filter("contaminated").isEmpty()
            clean = contamination(before, bench).filter("NOT contaminated").select("doc_id")
            assert clean.join(docs, "doc_id", "left_anti").isEmpty()
            last = docs
    assert docs.select("doc_id").distinct().count() == last.count()
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").isEmpty()
    assert kept["toxicity"] > 0.7 * spark.read.parquet(f"{SF}/documents.parquet").count()
