"""S12 on documents made of ``customer``, with faults by number."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import catalogs as ops
from tidewell.plans.registry import Binding, Registry
from tidewell.session import table

q = Registry()
QUERIES, SQL = q.queries, q.sql

_FIRST = """'{"stable_key": "a", "display_name": "A", "calculation_policy": ', CASE WHEN c_custkey % 5 = 1 THEN '"odd"' ELSE '"standard"' END, ', "official_capacity": ',
CASE c_custkey % 7 WHEN 1 THEN 'true' WHEN 2 THEN '0' WHEN 3 THEN 'null' ELSE '5' END, ', "source_codes": [{"source_code": "1", "configured_source_name": "N", "age_selector": ', CASE WHEN c_custkey % 3 = 1 THEN '"under_12"' ELSE '"all"' END, '}]}'"""
_SECOND = """'{"stable_key": ', CASE WHEN c_custkey % 23 = 1 THEN '" a"' ELSE '"b"' END, ', "display_name": "B", "calculation_policy": "unrated"', CASE WHEN c_custkey % 29 = 1 THEN ', "official_capacity": 3' ELSE '' END, ', "source_codes": ',
CASE c_custkey % 31 WHEN 1 THEN '[]' WHEN 2 THEN '[4]' ELSE concat('[{"source_code": "2", "configured_source_name": ', CASE WHEN c_custkey % 37 = 1 THEN '" "' ELSE '"M"' END, '}]') END, '}'"""
_DOCUMENT = f"""CASE c_custkey % 19 WHEN 1 THEN 'not json' WHEN 2 THEN '[]' ELSE concat('{{"schema_version": ', CASE c_custkey % 11 WHEN 1 THEN '""' WHEN 2 THEN '7' WHEN 3 THEN '"9.9"' ELSE '"2.0"' END, ', "source_reference": "r"',
CASE WHEN c_custkey % 13 = 1 THEN '' ELSE ', "occupancy_algorithm_version": "occupancy-v3"' END, ', "groups": [', {_FIRST}, ', ', {_SECOND}, ']', CASE WHEN c_custkey % 17 = 1 THEN ', "extra": 1' ELSE '' END, '}}') END"""
_DOCUMENTS = Binding("customer", "c_custkey AS id", f"{_DOCUMENT} AS document", "CASE WHEN c_custkey % 41 = 1 THEN '2024/02/01' ELSE CAST(CAST('2024-01-01' AS DATE) + CAST(c_custkey % 60 AS INT) AS STRING) END AS effective_from")

_FAULTS = f"""WITH d AS ({_DOCUMENTS.sql}), c AS (SELECT id, id % 19 NOT IN (1, 2) AS ok, effective_from FROM d), f AS (
SELECT id, '$' AS path, 'not_json' AS fault FROM c WHERE id % 19 = 1 UNION ALL SELECT id, '$', 'not_an_object' FROM c WHERE id % 19 = 2
UNION ALL SELECT id, 'effective_from', CASE WHEN id % 41 = 1 THEN 'not_a_date' ELSE 'not_later' END FROM c WHERE id % 41 = 1 OR id % 60 <= 19
UNION ALL SELECT id, '$.schema_version', CASE WHEN id % 11 = 3 THEN 'unsupported' ELSE 'missing' END FROM c WHERE ok AND id % 11 IN (1, 2, 3)
UNION ALL SELECT id, '$.occupancy_algorithm_version', 'missing' FROM c WHERE ok AND id % 13 = 1 AND id % 11 NOT IN (1, 2, 3)
UNION ALL SELECT id, '$.extra', 'unknown_key' FROM c WHERE ok AND id % 17 = 1
UNION ALL SELECT id, '$.groups[0].calculation_policy', 'unsupported' FROM c WHERE ok AND id % 5 = 1
UNION ALL SELECT id, '$.groups[0].official_capacity', CASE id % 7 WHEN 1 THEN 'not_an_integer' WHEN 2 THEN 'not_positive' ELSE 'missing' END FROM c WHERE ok AND (id % 7 IN (1, 2) OR (id % 7 = 3 AND id % 5 <> 1))
UNION ALL SELECT id, '$.groups[0].source_codes[0]', 'incomplete_partition' FROM c WHERE ok AND id % 3 = 1
UNION ALL SELECT id, '$.groups[1].stable_key', 'repeated' FROM c WHERE ok AND id % 23 = 1
UNION ALL SELECT id, '$.groups[1].official_capacity', 'not_allowed' FROM c WHERE ok AND id % 29 = 1
UNION ALL SELECT id, '$.groups[1].source_codes', 'missing' FROM c WHERE ok AND id % 31 = 1 UNION ALL SELECT id, '$.groups[1].source_codes[0]', 'not_an_object' FROM c WHERE ok AND id % 31 = 2
UNION ALL SELECT id, '$.groups[1].source_codes[0].configured_source_name', 'missing' FROM c WHERE ok AND id % 31 NOT IN (1, 2) AND id % 37 = 1)"""


def _documents(spark, sf_dir):
    """The documents; their keys, a few bytes each and few splits of a file, are dealt over all cores before texts are made of them."""
    keys = table(spark, sf_dir, "customer").select("c_custkey")
    return keys.repartition(4 * spark.sparkContext.defaultParallelism).selectExpr(*_DOCUMENTS.columns)


@q(f"{_FAULTS} SELECT * FROM f")
def s12_catalog_faults(spark, sf_dir):
    return ops.catalog_faults(_documents(spark, sf_dir), F.lit("2024-01-20").cast("date"))


@q(f"{_FAULTS} SELECT id, sha256(document) AS sha256 FROM d WHERE id NOT IN (SELECT id FROM f)")
def s12_valid_catalogs(spark, sf_dir):
    return ops.valid_catalogs(_documents(spark, sf_dir), F.lit("2024-01-20").cast("date")).select("id", "sha256")
