"""Gaps, cycles, silent jobs, flow and search on small inputs with known results."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidewell.operators import flow, planning, search

NOW = datetime.datetime(2026, 4, 10, 12, 0)


def ago(minutes):
    return NOW - datetime.timedelta(minutes=minutes)


def day(n):
    return datetime.date(2026, 4, n)


GAPS = {
    "all": ([10, 11, 12], 10, 12, 0, []),
    "none": ([], 10, 12, 0, [(10, 12)]),
    "begin": ([12], 10, 12, 0, [(10, 11)]),
    "end": ([10], 10, 12, 0, [(11, 12)]),
    "middle": ([10, 14], 10, 14, 0, [(11, 13)]),
    "several": ([10, 13], 10, 15, 0, [(11, 12), (14, 15)]),
    "one day": ([10], 10, 10, 0, []),
    "one day, none": ([], 10, 10, 0, [(10, 10)]),
    "overlap": ([10], 10, 12, 1, [(10, 12)]),
    "overlap is kept inside": ([10], 10, 12, 5, [(10, 12)]),
    "overlap of the first alone": ([10, 11, 14], 10, 16, 1, [(11, 13), (15, 16)]),
    "what lies outside": ([8, 9, 13, 10], 10, 12, 0, [(11, 12)]),
}


@pytest.mark.parametrize("name", GAPS)
def test_gaps(spark, name):
    covered, first, last, overlap, want = GAPS[name]
    people = spark.createDataFrame([(1,), (1,)], "p int")
    days = spark.createDataFrame([(1, day(n)) for n in covered + covered[:1]] + [(2, day(11)), (None, day(12))], "p int, day date")
    out = planning.coverage_gaps(people, days, "p", str(day(first)), str(day(last)), overlap).orderBy("gap_start").collect()
    assert [(r["p"], r["gap_start"].day, r["gap_end"].day) for r in out] == [(1, a, b) for a, b in want]


RUN = "status string, intent string, queued_at timestamp, started timestamp, finished timestamp"
CENSUS = "census_extraction"
CYCLES = {
    "nothing": ([], [], True, {}),
    "done": ([("succeeded", "full_sync", 20, 20, 10)], [], True, {}),
    "closed batch": ([], [5], True, {"open_batches": 0}),
    "queued": ([("queued", "full_sync", 5, None, None)], [], False, {"queued": 1, "running": 0}),
    "running": ([("running", "full_sync", 5, 5, None)], [], False, {"queued": 0, "running": 1, "stale": 0}),
    "both": ([("queued", "x", 5, None, None)] * 2 + [("running", "x", 5, 5, None)] * 3, [], False, {"queued": 2, "running": 3}),
    "open batch": ([], [5, None], False, {"open_batches": 1}),
    "recent census": ([("succeeded", CENSUS, 10, 10, 5)], [], False, {"cooldown_left": 20.0}),
    "newest census counts": ([("succeeded", CENSUS, 45, 45, 40), ("succeeded", CENSUS, 5, 5, 1)], [], False, {"cooldown_left": 25.0}),
    "old census": ([("succeeded", CENSUS, 60, 60, 50)], [], True, {"cooldown_left": None}),
    "other intents don't cool": ([("succeeded", "full_sync", 5, 5, 1)], [], True, {"cooldown_left": None}),
    "failed census": ([("failed", CENSUS, 90, 90, 80)], [], True, {"cooldown_left": None, "backoff_left": None}),
    "failed lately": ([("failed", CENSUS, 90, 90, 10)], [], False, {"cooldown_left": None, "backoff_left": 20.0}),
    "stale": ([("running", CENSUS, 300, 200, None)], [], False, {"stale": 1}),
    "stale by its place in the queue": ([("running", CENSUS, 300, None, None), ("running", CENSUS, 300, 10, None)], [], False, {"stale": 1, "running": 2}),
}


@pytest.mark.parametrize("name", CYCLES)
def test_eligibility(spark, name):
    runs, batches, eligible, said = CYCLES[name]
    at = lambda m: None if m is None else ago(m)
    runs = spark.createDataFrame([(s, i, at(q), at(b), at(e)) for s, i, q, b, e in runs], RUN)
    (r,) = planning.eligibility(runs, spark.createDataFrame([(at(b),) for b in batches], "finished timestamp"), F.lit(NOW), 30, 180, 30).collect()
    assert (r["eligible"], {k: r[k] for k in said}) == (eligible, said)


def test_stale_runs_by_intent_and_heartbeat(spark):
    rows = [(1, "admissions_only", "running", 21, None), (2, "admissions_only", "running", 90, 2), (3, "admissions_only", "running", 19, None), (4, "admissions_only", "succeeded", 90, None)]
    rows += [(5, "demographics_only", "running", 21, None), (6, "full_sync", "running", 59, None), (7, "full_sync", "running", 61, None), (8, CENSUS, "running", 121, None)]
    rows += [(9, "custom_intent", "running", 61, None), (10, "", "running", 61, None), (11, None, "running", 61, None), (12, "full_sync", "running", 61, 11)]
    runs = spark.createDataFrame([(n, i, s, ago(b), h and ago(h)) for n, i, s, b, h in rows], "run int, intent string, status string, started timestamp, heartbeat timestamp")
    assert sorted(r["run"] for r in planning.stale_runs(runs, F.lit(NOW)).collect()) == [1, 5, 7, 8, 9, 10, 11, 12]


def test_flow_of_days(spark):
    """Captures of a day are averaged; a day without one breaks the change; what neither explains is left."""
    captures = {(10, 8): 4, (11, 8): 6, (11, 20): 8, (13, 8): 10, (14, 8): 5}
    beds = [(datetime.datetime(2026, 4, d, h), "occupied") for (d, h), n in captures.items() for _ in range(n)] + [(datetime.datetime(2026, 4, 12, 8), "empty")]
    adc = flow.average_daily_census(spark.createDataFrame(beds, "at timestamp, status string"), F.col("at"), F.col("status") == "occupied")
    flows = spark.createDataFrame([(day(10), 3, 1, 0), (day(11), 5, 2, 1), (day(14), 1, 4, 2)], "day date, admissions int, discharges int, deaths int")
    out = flow.hospital_flow(flow.calendar(spark, "2026-04-10", "2026-04-14"), adc, flows).orderBy("day").collect()
    found = [(r["day"].day, r["adc"], r["captures"], r["admissions"], r["net_flow"], r["delta"], r["residual"]) for r in out]
    assert found == [(10, 4.0, 1, 3, 2, None, None), (11, 7.0, 2, 5, 2, 3.0, 1.0), (12, None, 0, 0, 0, None, None), (13, 10.0, 1, 0, 0, None, None), (14, 5.0, 1, 1, -5, -5.0, 0.0)]


def test_substring_search(spark):
    notes = ["Paciente com quadro de pneumonia bacteriana. Saturacao estavel em 96%.", "Realizada troca de curativo.", "SATURACAO", None, "", "boa saturacao hoje", "saturacao", "100% (saturacao)"]
    rows = spark.createDataFrame([(n, ago(n), t) for n, t in enumerate(notes)], "id int, at timestamp, text string")
    ids = lambda q, limit=50: [r["id"] for r in search.substring_search(rows, "text", q, "at", "id", limit).collect()]
    assert ids("pneumonia") == [0] and ids("astronauta espacial") == [] and ids("") == ids("  ") == []
    assert ids("saturacao") == [2, 6, 0, 5, 7] and ids("Saturacao", 2) == [2, 6] and ids("100%") == [7] and ids("_") == []
