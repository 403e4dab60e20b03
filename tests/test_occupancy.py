"""Measurements, coverage and days of small censuses with known results."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidewell.operators import coverage, occupancy

ROWS = "run int, captured_at timestamp, id int, code string, name string, bed string, status string, record string, patient string, band string"
CATALOG = "`group` string, policy string, capacity int, code string, selector string"
SPLIT = [("adult", "standard", 32, "654", "age_12_or_over"), ("infant", "standard", 16, "654", "under_12")]
DAY = datetime.date(2024, 5, 6)


def bed(run, n, code, name="Sector A", status="occupied", record=None, band="age_12_or_over", at=8, place=None):
    return (run, datetime.datetime(2024, 5, 6, at), n, code, name, f"B{n}" if place is None else place, status, f"R{n}" if record is None else record, "", band)


@pytest.fixture
def measured(spark):
    def of(beds, groups):
        rows, catalog = spark.createDataFrame(beds, ROWS), spark.createDataFrame(groups, CATALOG)
        places = occupancy.positions(rows)
        grouped = occupancy.grouped_positions(places, catalog)
        return rows, catalog, places, grouped, occupancy.group_measurements(grouped, catalog, rows)

    return of


def day_of(rows, catalog, places, grouped, groups):
    bridge = occupancy.reconciliation(rows, places, grouped).select("run", "age_partial", "position_partial")
    times = rows.groupBy("run").agg(F.min("captured_at").alias("at"), F.to_date(F.min("captured_at")).alias("day"))
    m = occupancy.hospital_totals(groups).join(bridge, "run").join(coverage.sector_counts(rows, catalog), "run").join(times, "run")
    out = coverage.daily_hospital(m, "day", "at", occupancy.is_eligible(F.lit("occupancy-v3"), F.col("age_partial"), F.col("position_partial"))).collect()
    assert len(out) == 1 and out[0]["day"] == DAY
    return out[0]


def test_bridge_of_raw_rows(measured):
    groups = [("A", "standard", 10, "100", "all"), ("B", "standard", 10, "200", "all"), *SPLIT, ("CO", "unrated", None, "20", "all")]
    beds = [bed(1, 0, "100", record="A1", place="A1"), bed(1, 1, "100", record="A1", place="A1"), bed(1, 2, "100", record="A2", place="A2"), bed(1, 3, "200", "Sector B", record="B1", place="B1")]
    beds += [bed(1, 4, "200", "Sector B", record="B2", place="B1"), bed(1, 5, "100", place=""), bed(1, 6, "654", "3A", band="unknown"), bed(1, 7, "20", "CO")]
    rows, _, places, grouped, found = measured(beds, groups)
    (r,) = occupancy.reconciliation(rows, places, grouped).collect()
    parts = ("raw_occupied_rows", "duplicate_occupied_rows", "conflict_occupied_rows", "unidentified_occupied_rows", "unknown_age_rows", "outside_calculable", "official_numerator")
    assert [r[p] for p in parts] == [8, 1, 2, 1, 1, 1, 2] and r["age_partial"] and r["position_partial"]
    assert {g["group"] for g in found.collect()} == {"A", "B", "adult", "infant", "CO"}


def test_split_code_makes_no_unmapped_group(measured):
    """An unknown age is in no band, but its code is in the catalog; likewise a bed of it that is empty."""
    beds = [bed(1, 0, "654"), bed(1, 1, "654", band="under_12"), bed(1, 2, "654", band="unknown"), bed(1, 3, "654", status="empty", band="not_applicable")]
    rows, _, places, grouped, groups = measured(beds, SPLIT)
    assert sorted((g["group"], g["occupied"], g["policy"]) for g in groups.collect()) == [("adult", 1, "standard"), ("infant", 1, "standard")]
    (t,) = occupancy.hospital_totals(groups).collect()
    assert (t["occupied_for_rate"], t["known_capacity"], t["calculable_capacity"], t["pct"]) == (2, 48, 48, Decimal("4.17"))


def test_unmapped_keys_tell_codes_from_names(measured):
    beds = [bed(1, 0, "100"), bed(1, 1, "999", "Unknown"), bed(1, 2, "", "Sector A"), bed(1, 3, "", "999")]
    rows, catalog, places, grouped, groups = measured(beds, [("A", "standard", 10, "100", "all")])
    assert sorted(g["group"].rpartition("-")[0] for g in groups.filter("policy = 'unmapped'").collect()) == ["UNMAPPED-BLANK", "UNMAPPED-BLANK", "UNMAPPED-CODE"]
    (c,) = coverage.sector_counts(rows, catalog).collect()
    assert (c["observed_sectors"], c["covered_sectors"], c["calculable_sectors"]) == (4, 1, 1)


def test_names_that_drift_are_said_and_change_nothing(spark, measured):
    beds = [bed(1, 0, "100", "Renamed"), bed(1, 1, "100", "Sector A", status="empty"), bed(1, 2, "100", "Sector A"), bed(1, 3, "999", "Other")]
    rows, _, places, grouped, groups = measured(beds, [("A", "standard", 10, "100", "all"), ("A", "standard", 10, "101", "all")])
    named = spark.createDataFrame([("A", "100", "Sector A", "all"), ("A", "101", "Sector B", "all")], "`group` string, code string, name string, selector string")
    out = coverage.components(places, named, rows, grouped.filter("policy IS NULL AND group IS NOT NULL")).collect()
    found = {(r["configured_code"], r["observed_name"]): (r["group"][:8], r["observed_code"], r["status_counts"], r["name_mismatch"]) for r in out}
    assert found == {
        ("100", "Renamed"): ("A", "100", {"occupied": 1}, True), ("100", "Sector A"): ("A", "100", {"empty": 1, "occupied": 1}, False),
        ("101", None): ("A", "101", {}, False), (None, "Other"): ("UNMAPPED", "999", {"occupied": 1}, False),
    }


def test_day_means_and_bounds(measured):
    beds = [bed(1, n, "100") for n in range(5)] + [bed(2, n, "100", at=20) for n in range(10)]
    d = day_of(*measured(beds, [("A", "standard", 8, "100", "all")]))
    assert (d["measurements"], d["mean_occupied"], d["min_occupied"], d["max_occupied"], d["max_exceeded_by"]) == (2, Decimal("7.50"), 5, 10, 2)
    assert (d["mean_pct"], d["min_pct"], d["max_pct"], d["first_captured_at"].hour, d["last_captured_at"].hour) == (Decimal("93.75"), Decimal("62.50"), Decimal("125.00"), 8, 20)


def test_mean_is_of_exact_shares(measured):
    """0 and two thirds have a mean of 33.33, where rounded ones would have 33.34."""
    beds = [bed(1, 0, "100", status="empty", band="not_applicable")] + [bed(2, n, "100", at=20) for n in range(2)]
    assert day_of(*measured(beds, [("A", "standard", 3, "100", "all")]))["mean_pct"] == Decimal("33.33")


def test_day_with_a_partial_capture(measured):
    d = day_of(*measured([bed(1, 0, "654"), bed(1, 1, "654"), bed(2, 0, "654", band="unknown", at=20)], SPLIT))
    assert (d["measurements"], d["eligible"], d["age_excluded"], d["position_excluded"], d["last_captured_at"].hour) == (2, 1, 1, 0, 20)
    assert (d["mean_occupied"], d["max_occupied"], d["mean_pct"], d["max_exceeded_by"]) == (Decimal("2.00"), 2, Decimal("4.17"), 0)


def test_day_of_partial_captures_alone(measured):
    d = day_of(*measured([bed(1, 0, "654", band="unknown"), bed(1, 1, "999")], SPLIT))
    assert (d["eligible"], d["age_excluded"], d["mean_occupied"], d["min_occupied"], d["mean_pct"], d["max_exceeded_by"]) == (0, 1, None, None, None, None)
    assert (d["known_capacity"], d["min_observed_sectors"], d["min_covered_sectors"]) == (48, 2, 1)


def test_sectors_of_a_day(measured):
    beds = [bed(1, 0, "100"), bed(1, 1, "999", "Unknown"), bed(2, 0, "100", at=20)]
    d = day_of(*measured(beds, [("A", "standard", 10, "100", "all")]))
    assert [d[c] for c in ("min_observed_sectors", "max_observed_sectors", "min_covered_sectors", "max_covered_sectors", "min_calculable_sectors", "max_calculable_sectors")] == [1, 2, 1, 1, 1, 1]
