"""Expected values of small fixtures, and invariants."""

import datetime

from pyspark.sql import functions as F

from tidewell.functions import classes, dates
from tidewell.operators import ledger, occupancy, planning, presentation
from tidewell.operators.series import exponential_average
from tidewell.plans import occupancy as bound

D = datetime.date


def test_windows(spark):
    rows = [(1, D(2025, 1, 1), D(2025, 1, 10)), (2, D(2025, 1, 1), D(2025, 1, 20)), (3, D(2025, 1, 1), D(2025, 1, 9))]
    requests = spark.createDataFrame(rows, "request int, admission_date date, target_end_date date").withColumns({"mode": F.lit("generate"), "prior_coverage_end": F.lit(None).cast("date")})
    out = planning.windows(requests, 5, 2).orderBy("request", "position").collect()
    assert [(r["window_start"].day, r["window_end"].day) for r in out if r["request"] == 1] == [(1, 5), (4, 8), (7, 10)]
    assert sum(r["request"] == 2 for r in out) == 6
    assert [r["window_end"].day for r in out if r["request"] == 3][-1] == 9


def test_exponential_average(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 20])], "d int, v int").withColumn("k", F.lit(1))
    out = [r["e"] for r in exponential_average(rows, ["k"], "d", "v", 7, "e").orderBy("d").collect()]
    assert out[:6] == [None] * 6 and out[6:] == [4, 5, 6, 9.5]
    short = exponential_average(rows.limit(3), ["k"], "d", "v", 7, "e").collect()
    assert [r["e"] for r in short] == [None] * 3


def test_year_inference(spark):
    rows = spark.createDataFrame([("05/01",), ("31/12",), ("29/02",), ("01/02/2020",), ("x",), (None,)], "d string")
    out = [r["v"] for r in rows.select(dates.inferred_date(F.col("d"), D(2025, 6, 1)).alias("v")).collect()]
    assert out == [D(2025, 1, 5), D(2024, 12, 31), None, D(2020, 2, 1), None, None]


def test_age_bands(spark):
    rows = spark.createDataFrame([("11",), ("12",), ("3m2d",), ("144m",), ("2.5",), (None,)], "a string")
    out = [r["b"] for r in rows.select(classes.age_band(F.col("a"), F.lit("occupied")).alias("b")).collect()]
    assert out == ["under_12", "age_12_or_over", "under_12", "age_12_or_over", "unknown", "unknown"]


def test_reconciliation_closes(spark):
    rows, places, grouped, _ = bound._steps(spark, "/root/testdata/sf0.001")
    for r in occupancy.reconciliation(rows, places, grouped).collect():
        parts = ("duplicate_occupied_rows", "conflict_occupied_rows", "unidentified_occupied_rows", "unknown_age_rows", "outside_calculable", "official_numerator")
        assert sum(r[p] for p in parts) == r["raw_occupied_rows"]


def test_ledger_is_idempotent(spark):
    batch = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "a", "x"), (4, "b", "x")], "n int, identity string, content string")
    first = ledger.ledger_actions(batch, batch.limit(0), "n").orderBy("n").collect()
    assert [r["action"] for r in first] == ["created", "revised", "skipped", "created"]
    again = ledger.ledger_actions(batch, batch, "n").collect()
    assert {r["action"] for r in again} == {"skipped"}


def test_no_gaps_and_one_gap(spark):
    people = spark.createDataFrame([(1,), (2,)], "p int")
    covered = spark.createDataFrame([(1, D(2024, 1, d)) for d in range(1, 6)], "p int, day date")
    out = planning.coverage_gaps(people, covered, "p", "2024-01-01", "2024-01-05", 1).collect()
    assert [(r["p"], r["gap_start"], r["gap_end"]) for r in out] == [(2, D(2024, 1, 1), D(2024, 1, 5))]


def test_presentation_of_groups_and_sectors(spark):
    """A shared group once with all beds, a split code by band, and one auxiliary row for what no band takes."""
    beds = [(1, "101", "Clinica", "L1", "occupied", "age_12_or_over"), (2, "102", "Clinica B", "L1", "empty", "not_applicable"), (3, "654", "Ped", "P1", "occupied", "under_12")]
    beds += [(4, "654", "Ped", "P2", "occupied", "unknown"), (5, "654", "Ped", "P3", "empty", "not_applicable"), (6, "", "Sem codigo", "X", "occupied", "under_12"), (7, "101", "Clinica", "L1", "occupied", "age_12_or_over")]
    rows = spark.createDataFrame([(1, i, c, n, b, s, f"r{i % 6}", f"p{i % 6}", band) for i, c, n, b, s, band in beds], "run int, id int, code string, name string, bed string, status string, record string, patient string, band string")
    catalog = spark.createDataFrame([("g1", "standard", 10, "101", "all"), ("g1", "standard", 10, "102", "all"), ("kids", "standard", 5, "654", "under_12"), ("grown", "standard", 5, "654", "age_12_or_over")], "`group` string, policy string, capacity int, code string, selector string")
    places = occupancy.positions(rows)
    grouped = occupancy.grouped_positions(places, catalog)
    measured = presentation.with_status_counts(occupancy.group_measurements(grouped, catalog, rows), grouped, ["run"])
    out = {r["group"]: r for r in presentation.group_presentation(rows, catalog, measured).collect()}
    assert [b["id"] for b in out["g1"]["beds"]] == [1, 2, 7] and out["g1"]["source_sectors"] == ["Clinica", "Clinica B"]
    assert [b["id"] for b in out["kids"]["beds"]] == [3] and out["grown"]["beds"] == [] and out["grown"]["occupied"] == 0
    extra = out[presentation.AUXILIARY]
    assert [b["id"] for b in extra["beds"]] == [4, 5] and extra["status_counts"] == {"empty": 1, "occupied": 1} and extra["capacity"] is None and extra["pct"] is None
    assert extra["beds"][1]["patient"] == "" and extra["beds"][0]["patient"] == "p4"
    sectors = {r["source"]: r for r in presentation.sector_presentation(rows).collect()}
    assert sectors["101"]["positions_by_status"] == {"occupied": 1} and sectors["101"]["duplicate_extra_rows"] == 1 and sectors["101"]["conflict_positions"] == 0
    other = rows.withColumn("record", F.when(F.col("id") == 7, "another").otherwise(F.col("record")))
    clash = {r["source"]: r for r in presentation.sector_presentation(other).collect()}["101"]
    assert clash["conflict_positions"] == 1 and clash["positions"][0]["status"] == "conflict" and clash["positions"][0]["patient"] == ""


def test_exact_measurement(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), ("c", None), ("d", 3), ("e", 4), ("e", None)], "census string, run int")
    measured = spark.createDataFrame([(1,), (2,), (4,)], "run int")
    assert presentation.exact_measurement(rows, measured, "census").collect() == [("a", 1)]


def test_daily_groups_fall_back_to_status_counts(spark):
    day = D(2024, 1, 1)
    rows = [(day, 1, "g", "standard", "calculated", 4, 3, 0, {"occupied": 3}, True), (day, 2, "g", "standard", "calculated", 4, 6, 2, {"occupied": 6}, True), (day, 3, "g", "standard", "calculated", 4, 1, 0, {}, False)]
    rows += [(day, 1, "p", "pending", "not_calculated", None, None, None, {"occupied": 2, "empty": 1}, True), (day, 2, "p", "pending", "not_calculated", None, None, None, {"empty": 1}, True)]
    df = spark.createDataFrame(rows, "day date, at int, `group` string, policy string, status string, capacity int, occupied long, exceeded_by int, status_counts map<string,bigint>, ok boolean")
    out = {r["group"]: r for r in presentation.daily_groups(df, "day", "at", F.col("ok")).collect()}
    g, p = out["g"], out["p"]
    assert (g["measurements"], float(g["mean_occupied"]), g["max_occupied"], float(g["mean_pct"]), float(g["max_pct"]), g["max_exceeded_by"]) == (2, 4.5, 6, 112.5, 150.0, 2)
    assert (p["measurements"], float(p["mean_occupied"]), p["min_occupied"], p["mean_pct"], p["max_exceeded_by"]) == (2, 1.0, 0, None, None)
