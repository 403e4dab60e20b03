"""Catalog documents are checked within their rows."""

import datetime
import json

from pyspark.sql import functions as F

from tests.compare import connect, same
from tests.test_catalogs import code, document, group
from tests.test_findings import tables
from tests.test_oracle import QUERIES, SQL
from tidewell.operators.catalogs import catalog_faults, valid_catalogs


def today():
    return F.lit("2024-01-31").cast("date")


def documents(spark, *rows):
    return spark.createDataFrame([(k, json.dumps(d), "2024-02-01") for k, d in rows], "id string, document string, effective_from string")


def steps(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [plan.count(word) for word in ("Relation ", "Join", "Aggregate ")]


def test_valid_catalogs_read_documents_once(spark):
    assert steps(QUERIES["s12_valid_catalogs"](spark, "/root/testdata/sf0.001")) == [1, 0, 0]


def test_a_document_with_a_fault_and_no_id_is_not_valid(spark, tmp_path):
    customer = spark.createDataFrame([(None,), (20,), (21,), (22,), (None,)], "c_custkey long")
    sf_dir = tables(spark, tmp_path, customer=customer)
    assert same(QUERIES["s12_valid_catalogs"](spark, sf_dir), connect(sf_dir), SQL["s12_valid_catalogs"]) is None


def test_valid_documents_keep_their_columns(spark):
    rows = documents(spark, ("a", document(group())), ("b", document())).withColumn("f", F.lit(datetime.date(2024, 1, 1)))
    out = valid_catalogs(rows, today())
    assert out.columns == [*rows.columns, "sha256"] and [r["id"] for r in out.collect()] == ["a"]


def test_catalog_faults_read_documents_once(spark):
    assert steps(QUERIES["s12_catalog_faults"](spark, "/root/testdata/sf0.001")) == [1, 0, 0]


def test_documents_of_one_id_are_judged_apart(spark):
    out = catalog_faults(documents(spark, ("a", document(group())), ("a", document(group())), ("a", document())), today()).collect()
    assert [(r["path"], r["fault"]) for r in out] == [("$.groups", "missing")]


def test_a_long_document(spark):
    n = 3000
    long = document(*(group(f"k{g % (n - 1)}", [code(f"{g // 2}", ("under_12", "age_12_or_over")[g % 2])]) for g in range(n)), group("x", [code("0"), code("y", "under_12"), code("y", "age_12_or_over")]), 5)
    out = catalog_faults(documents(spark, ("a", long)), today()).collect()
    found = {(f"$.groups[{n - 1}].stable_key", "repeated"), ("$.groups[0].source_codes[0]", "all_with_another"), (f"$.groups[{n}].source_codes[1]", "partition_in_one_group"), (f"$.groups[{n + 1}]", "not_an_object")}
    assert {(r["path"], r["fault"]) for r in out} == found and len(out) == 4
