"""Faults of catalog documents, one by one."""

import json

import pytest
from pyspark.sql import functions as F

from tidewell.operators.catalogs import catalog_faults


def code(source="101", selector=None, name="N"):
    return {"source_code": source, "configured_source_name": name} | ({"age_selector": selector} if selector else {})


def group(key="g", codes=None, policy="standard", capacity=4, **more):
    return {"stable_key": key, "display_name": key.upper(), "calculation_policy": policy, "official_capacity": capacity, "source_codes": codes if codes is not None else [code()]} | more


def document(*groups, **more):
    return {"schema_version": "2.0", "source_reference": "r", "occupancy_algorithm_version": "occupancy-v3", "groups": list(groups)} | more


CASES = {
    "good": (document(group()), []),
    "pair": (document(group("a", [code("654", "under_12")]), group("b", [code("654", "age_12_or_over")])), []),
    "legacy": (document(group(), schema_version="1.1", occupancy_algorithm_version=None), []),
    "legacy_algorithm": (document(group(), schema_version="1.0"), [("$.occupancy_algorithm_version", "not_allowed")]),
    "algorithm": (document(group(), occupancy_algorithm_version="occupancy-v9"), [("$.occupancy_algorithm_version", "unsupported")]),
    "no_groups": (document(), [("$.groups", "missing")]),
    "groups_no_list": (document(group(), groups={"a": 1}), [("$.groups", "missing")]),
    "group_no_object": (document("x"), [("$.groups[0]", "not_an_object")]),
    "long_key": (document(group("k" * 101)), [("$.groups[0].stable_key", "too_long")]),
    "key_no_text": (document(group(stable_key=5)), [("$.groups[0].stable_key", "missing")]),
    "twice": (document(group("a"), group("a ", [code("2")]), group("a", [code("3")])), [("$.groups[1].stable_key", "repeated"), ("$.groups[2].stable_key", "repeated")]),
    "policy": (document(group(policy="free")), [("$.groups[0].calculation_policy", "unsupported")]),
    "fraction": (document(group(capacity=1.5)), [("$.groups[0].official_capacity", "not_an_integer")]),
    "truth": (document(group(capacity=True)), [("$.groups[0].official_capacity", "not_an_integer")]),
    "below": (document(group(capacity=-1)), [("$.groups[0].official_capacity", "not_positive")]),
    "no_capacity": (document(group(policy="linked_slots_pending", capacity=None)), [("$.groups[0].official_capacity", "missing")]),
    "unrated": (document(group(policy="unrated")), [("$.groups[0].official_capacity", "not_allowed")]),
    "selector": (document(group(codes=[code(selector="old")])), [("$.groups[0].source_codes[0]", "incomplete_partition"), ("$.groups[0].source_codes[0].age_selector", "unsupported")]),
    "all_and_band": (document(group("a", [code("1")]), group("b", [code("1", "under_12")])), [("$.groups[0].source_codes[0]", "all_with_another")]),
    "same_group": (document(group("a", [code("1", "under_12"), code("1", "age_12_or_over")])), [("$.groups[0].source_codes[0]", "partition_in_one_group")]),
    "two_of_one": (document(group("a", [code("1", "under_12")]), group("b", [code("1", "under_12")])), [("$.groups[0].source_codes[0]", "incomplete_partition")]),
    "unknown": (document(group(codes=[code() | {"note": 1}], colour="x")), [("$.groups[0].colour", "unknown_key"), ("$.groups[0].source_codes[0].note", "unknown_key")]),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(k, json.dumps(d), "2024-02-01") for k, (d, _) in CASES.items()]
    rows += [("null", None, "2024-02-01"), ("text", "{", "2024-02-01"), ("today", json.dumps(document(group())), "2024-01-31"), ("no_day", json.dumps(document(group())), "2024-02-31"), ("no_date", json.dumps(document(group())), None)]
    out = catalog_faults(spark.createDataFrame(rows, "id string, document string, effective_from string"), F.lit("2024-01-31").cast("date")).collect()
    return {k: sorted((r["path"], r["fault"]) for r in out if r["id"] == k) for k, *_ in rows}


@pytest.mark.parametrize("name", CASES)
def test_faults(found, name):
    assert found[name] == sorted(CASES[name][1])


def test_no_documents_and_dates(found):
    assert found["null"] == found["text"] == [("$", "not_json")]
    assert found["today"] == [("effective_from", "not_later")] and found["no_day"] == found["no_date"] == [("effective_from", "not_a_date")]
