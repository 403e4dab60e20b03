"""Q01 to Q10, A17 to A22 and V01: beds made of ``events``, where a user and an hour are a bed, and a small catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import coverage
from tidewell.operators import occupancy as ops
from tidewell.operators import presentation as shown
from tidewell.operators.lookups import as_of
from tidewell.plans.registry import Binding, Registry
from tidewell.session import written

q = Registry()
QUERIES, SQL = q.queries, q.sql

_ROWS = Binding(
    "events", "event_id AS id", "CAST(ts AS DATE) AS run", "date_trunc('hour', ts) AS captured_at",
    "CASE WHEN user_id % 7 = 0 THEN '' ELSE concat('c', CAST(user_id % 7 AS STRING)) END AS code", "concat('Setor ', CAST(user_id % 3 AS STRING)) AS name",
    "CASE WHEN event_id % 41 = 0 THEN ' ' ELSE concat(CAST(user_id AS STRING), '-', CAST(hour(ts) AS STRING)) END AS bed",
    "CASE WHEN event_type = 'error' THEN 'empty' WHEN event_type = 'signup' THEN 'maintenance' ELSE 'occupied' END AS status",
    "event_type AS record", "concat(' p ', CAST(user_id AS STRING)) AS patient",
    "CASE WHEN event_type IN ('error', 'signup') THEN 'not_applicable' WHEN user_id % 5 = 0 THEN 'unknown' WHEN user_id % 2 = 0 THEN 'under_12' ELSE 'age_12_or_over' END AS band",
)
_CATALOG = """VALUES ('g1', 'standard', 40, 'c1', 'all'), ('g1', 'standard', 40, 'c2', 'all'), ('g2', 'standard', 30, 'c3', 'under_12'),
('g3', 'standard', 35, 'c3', 'age_12_or_over'), ('g4', 'pending', NULL, 'c4', 'all')"""

def _sql(rows, catalog):
    return f"""r AS ({rows}), cat(grp, policy, capacity, code, selector) AS ({catalog}),
k AS (SELECT *, upper(trim(bed)) AS b, CASE WHEN code <> '' THEN upper(code) ELSE upper(name) END AS src,
      CASE WHEN status = 'occupied' THEN status || '|' || upper(record) || '|' || band ELSE status END AS said FROM r),
pl AS (SELECT run, CASE WHEN b = '' THEN 'unidentified' WHEN count(DISTINCT said) > 1 THEN 'conflict' ELSE 'position' END AS kind, count(*) AS rows,
       count(*) FILTER (status = 'occupied') AS occupied_rows, arg_min(code, id) AS code, arg_min(name, id) AS name, arg_min(status, id) AS status, arg_min(band, id) AS band
       FROM k GROUP BY run, src, b, CASE WHEN b = '' THEN id END),
gp AS (SELECT p.*, c.policy, c.capacity, coalesce(c.grp, CASE WHEN p.code = 'c3' THEN NULL WHEN p.code <> '' THEN 'UNMAPPED-CODE-' || sha256('code' || chr(0) || p.code)[1:20] ELSE 'UNMAPPED-BLANK-' || sha256('blank' || chr(0) || p.name)[1:20] END) AS grp,
       p.code = 'c3' AND p.band = 'unknown' AND p.status = 'occupied' AS unknown_age
       FROM (SELECT * FROM pl WHERE kind = 'position') p LEFT JOIN cat c ON c.code = p.code AND (c.selector = 'all' OR c.selector = p.band)),
cn AS (SELECT run, grp, count(*) FILTER (status = 'occupied' AND NOT unknown_age) AS n, count(*) AS positions FROM gp WHERE grp IS NOT NULL GROUP BY 1, 2),
w AS (SELECT run, grp, policy, capacity FROM (SELECT DISTINCT run FROM r), (SELECT DISTINCT grp, policy, capacity FROM cat)),
gm AS (SELECT run, grp, coalesce(policy, 'unmapped') AS policy, capacity, coalesce(n, 0) AS occupied, coalesce(positions, 0) AS positions,
       coalesce(policy = 'standard' AND capacity IS NOT NULL, false) AS rated FROM w FULL JOIN cn USING (run, grp)),
gm2 AS (SELECT run, grp, policy, capacity, occupied, positions, CASE WHEN rated THEN round(occupied::DECIMAL(20,0) * 100 / nullif(capacity, 0)::DECIMAL(20,0), 2)::DECIMAL(12,2) END AS pct,
        CASE WHEN rated THEN greatest(occupied - capacity, 0) END AS exceeded_by, CASE WHEN rated THEN greatest(capacity - occupied, 0) END AS availability,
        CASE WHEN rated THEN 'calculated' ELSE 'not_calculated' END AS status FROM gm),
rc AS (SELECT run, raw_occupied_rows, duplicate_occupied_rows, conflict_occupied_rows, unidentified_occupied_rows, conflict_positions,
       coalesce(unknown_age_rows, 0) AS unknown_age_rows, coalesce(outside_calculable, 0) AS outside_calculable, coalesce(official_numerator, 0) AS official_numerator
       FROM (SELECT run, count(*) FILTER (status = 'occupied') AS raw_occupied_rows FROM r GROUP BY 1)
       JOIN (SELECT run, sum(CASE WHEN kind = 'position' THEN greatest(occupied_rows - 1, 0) ELSE 0 END)::BIGINT AS duplicate_occupied_rows,
             sum(CASE WHEN kind = 'conflict' THEN occupied_rows ELSE 0 END)::BIGINT AS conflict_occupied_rows,
             sum(CASE WHEN kind = 'unidentified' THEN occupied_rows ELSE 0 END)::BIGINT AS unidentified_occupied_rows, count(*) FILTER (kind = 'conflict') AS conflict_positions FROM pl GROUP BY 1) USING (run)
       LEFT JOIN (SELECT run, count(*) FILTER (status = 'occupied' AND unknown_age) AS unknown_age_rows,
             count(*) FILTER (status = 'occupied' AND NOT unknown_age AND policy IS DISTINCT FROM 'standard') AS outside_calculable,
             count(*) FILTER (status = 'occupied' AND NOT unknown_age AND policy = 'standard') AS official_numerator FROM gp GROUP BY 1) USING (run)),
ht AS (SELECT run, coalesce(sum(capacity), 0)::BIGINT AS known_capacity, coalesce(sum(capacity) FILTER (status = 'calculated'), 0)::BIGINT AS calculable_capacity,
       coalesce(sum(occupied) FILTER (status = 'calculated'), 0)::BIGINT AS occupied_for_rate, coalesce(sum(exceeded_by), 0)::BIGINT AS exceeded_by,
       coalesce(sum(availability), 0)::BIGINT AS availability FROM gm2 GROUP BY 1)"""



_SQL = _sql(_ROWS.sql, _CATALOG)

#: Captures of an hour, of which a day has several, and groups that these can fill.
_HOURLY = Binding("events", *[c.replace("CAST(ts AS DATE) AS run", "date_trunc('hour', ts) AS run").replace("event_id % 41 = 0", "event_id % 401 = 0").replace("user_id % 5 = 0", "user_id % 50 = 0") for c in _ROWS.columns])
_SMALL = """VALUES ('g1', 'standard', 4, 'c1', 'all'), ('g1', 'standard', 4, 'c2', 'all'), ('g2', 'standard', 2, 'c3', 'under_12'),
('g3', 'standard', 1, 'c3', 'age_12_or_over'), ('g4', 'pending', NULL, 'c4', 'all')"""
_HOURS = _sql(_HOURLY.sql, _SMALL)


def _catalog(spark, values=_CATALOG):
    return spark.sql(f"SELECT * FROM {values} AS c(`group`, policy, capacity, code, selector)")


def _steps(spark, sf_dir, binding=_ROWS, values=_CATALOG, of=lambda rows: rows):
    rows = of(binding.frame(spark, sf_dir))
    places, catalog = ops.positions(rows), _catalog(spark, values)
    return rows, places, ops.grouped_positions(places, catalog), ops.group_measurements(ops.grouped_positions(places, catalog), catalog, rows)


@q("""SELECT event_id, CAST(ts AS DATE) AS run, min(date_trunc('hour', ts)) OVER (PARTITION BY CAST(ts AS DATE)) AS captured_at FROM events WHERE day(ts) % 4 <> 0""")
def q01_run_rows(spark, sf_dir):
    rows = _ROWS.frame(spark, sf_dir)
    runs = rows.select("run").distinct().withColumn("status", F.when(F.dayofmonth("run") % 4 != 0, "succeeded").otherwise("failed"))
    return ops.run_rows(rows, runs).select(F.col("id").alias("event_id"), "run", "captured_at")


@q("""WITH v(since, catalog) AS (VALUES (DATE '2024-01-08', 'a'), (DATE '2024-01-20', 'b')), d AS (SELECT DISTINCT CAST(ts AS DATE) AS run FROM events)
SELECT run, catalog FROM d ASOF JOIN v ON d.run >= v.since""")
def q02_catalog_as_of(spark, sf_dir):
    versions = spark.sql("SELECT 0 AS k, * FROM VALUES (date'2024-01-08', 'a'), (date'2024-01-20', 'b') AS v(since, catalog)")
    days = _ROWS.frame(spark, sf_dir).select("run").distinct().withColumn("k", F.lit(0))
    return as_of(days, versions, ["k"], "run", "since", ["catalog"]).filter("catalog IS NOT NULL").drop("k")


_SELECTORS = Binding(
    "part", "p_partkey - p_partkey % 4 AS catalog", "CASE p_size % 6 WHEN 0 THEN 'under_12' WHEN 1 THEN 'age_12_or_over' ELSE 'all' END AS selector",
    "CASE WHEN p_partkey % 28 = 3 THEN 'occupancy-v3' END AS declared",
)


@q(f"SELECT catalog, coalesce(max(declared), CASE WHEN bool_or(selector <> 'all') THEN 'occupancy-v2' ELSE 'occupancy-v1' END) AS version FROM ({_SELECTORS.sql}) GROUP BY 1")
def q03_algorithm_version(spark, sf_dir):
    return ops.algorithm_version(_SELECTORS.frame(spark, sf_dir), F.col("declared"))


@q(f"WITH {_SQL} SELECT run, kind, count(*) AS n, sum(rows)::BIGINT AS rows, sum(occupied_rows)::BIGINT AS occupied_rows FROM pl GROUP BY 1, 2")
def q04_positions(spark, sf_dir):
    places = _steps(spark, sf_dir)[1]
    return places.groupBy("run", "kind").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"), F.sum("occupied_rows").alias("occupied_rows"))


@q(f'WITH {_SQL} SELECT run, grp AS "group", policy, capacity, occupied, positions, pct, exceeded_by, availability, status FROM gm2')
def q05_a17_a18_group_measurements(spark, sf_dir):
    return _steps(spark, sf_dir)[3]


@q(f"""WITH {_SQL} SELECT *, round(occupied_for_rate::DECIMAL(20,0) * 100 / nullif(calculable_capacity, 0)::DECIMAL(20,0), 2)::DECIMAL(12,2) AS pct FROM ht""")
def a19_a20_hospital_totals(spark, sf_dir):
    return ops.hospital_totals(_steps(spark, sf_dir)[3])


@q(f"WITH {_SQL} SELECT *, unknown_age_rows > 0 AS age_partial, conflict_positions > 0 OR unidentified_occupied_rows > 0 AS position_partial FROM rc")
def q06_q07_reconciliation(spark, sf_dir):
    rows, places, grouped, _ = _steps(spark, sf_dir)
    return ops.reconciliation(rows, places, grouped)


@q(f"""WITH {_HOURS}, e AS (SELECT ht.*, unknown_age_rows = 0 AND conflict_positions = 0 AND unidentified_occupied_rows = 0 AS ok FROM ht JOIN rc USING (run))
SELECT run::DATE AS day, count(*) AS measurements, count(*) FILTER (ok) AS eligible, avg(occupied_for_rate) FILTER (ok) AS mean,
min(occupied_for_rate) FILTER (ok) AS low, max(occupied_for_rate) FILTER (ok) AS high, min(run) AS first_captured_at, max(run) AS last_captured_at FROM e GROUP BY 1""")
def q08_a22_daily_statistics(spark, sf_dir):
    """Days of hourly measurements: those with partial positions or unknown ages do not count."""
    from tidewell.operators.metrics import eligible_summary

    rows, places, grouped, groups = _steps(spark, sf_dir, _HOURLY, _SMALL)
    bridge = ops.reconciliation(rows, places, grouped).select("run", "age_partial", "position_partial")
    e = ops.hospital_totals(groups).join(bridge, "run").withColumns({"day": F.to_date("run"), "captured_at": F.col("run")})
    return eligible_summary(e, "day", ops.is_eligible(F.lit("occupancy-v3"), F.col("age_partial"), F.col("position_partial")), "occupied_for_rate")


#: Sectors of a capture: codes, and names of rows without one.
_SECTORS = """(SELECT run, count(*) AS observed_sectors, count(*) FILTER (code IN ('c1', 'c2', 'c3')) AS covered_sectors, count(*) FILTER (code IN ('c1', 'c2', 'c3')) AS calculable_sectors
FROM (SELECT DISTINCT run, code, CASE WHEN code = '' THEN name END AS name FROM r) GROUP BY 1)"""


@q(f"""WITH {_HOURS}, m AS (SELECT ht.*, sc.* EXCLUDE (run), unknown_age_rows > 0 AS age_partial, conflict_positions > 0 OR unidentified_occupied_rows > 0 AS position_partial,
unknown_age_rows = 0 AND conflict_positions = 0 AND unidentified_occupied_rows = 0 AS ok, occupied_for_rate * 100.0 / calculable_capacity AS share FROM ht JOIN rc USING (run) JOIN {_SECTORS} sc USING (run))
SELECT run::DATE AS day, arg_min(known_capacity, run) AS known_capacity, arg_min(calculable_capacity, run) AS calculable_capacity, count(*) AS measurements, count(*) FILTER (ok) AS eligible,
count(*) FILTER (age_partial) AS age_excluded, count(*) FILTER (position_partial) AS position_excluded, min(run) AS first_captured_at, max(run) AS last_captured_at,
round(avg(occupied_for_rate) FILTER (ok), 2) AS mean_occupied, min(occupied_for_rate) FILTER (ok) AS min_occupied, max(occupied_for_rate) FILTER (ok) AS max_occupied,
round(avg(share) FILTER (ok), 2) AS mean_pct, round(min(share) FILTER (ok), 2) AS min_pct, round(max(share) FILTER (ok), 2) AS max_pct, max(exceeded_by) FILTER (ok) AS max_exceeded_by,
min(observed_sectors) AS min_observed_sectors, max(observed_sectors) AS max_observed_sectors, min(covered_sectors) AS min_covered_sectors, max(covered_sectors) AS max_covered_sectors,
min(calculable_sectors) AS min_calculable_sectors, max(calculable_sectors) AS max_calculable_sectors FROM m GROUP BY 1""")
def a21_daily_hospital(spark, sf_dir):
    """The day of the hospital, from hourly captures: official statistics of whole ones, and bounds of sectors of all."""
    rows, places, grouped, groups = _steps(spark, sf_dir, _HOURLY, _SMALL)
    bridge = ops.reconciliation(rows, places, grouped).select("run", "age_partial", "position_partial")
    measured = ops.hospital_totals(groups).join(bridge, "run").join(coverage.sector_counts(rows, _catalog(spark, _SMALL)), "run").withColumn("day", F.to_date("run"))
    return coverage.daily_hospital(measured, "day", "run", ops.is_eligible(F.lit("occupancy-v3"), F.col("age_partial"), F.col("position_partial")))


_NAMED = "VALUES ('g1', 'c1', 'Setor 1', 'all'), ('g1', 'c2', 'Setor 2', 'all'), ('g2', 'c3', 'Setor 0', 'under_12'), ('g3', 'c3', 'Setor 0', 'age_12_or_over'), ('g4', 'c4', 'Setor 1', 'all')"


@q(f"""WITH {_SQL}, mem(grp, code, name, selector) AS ({_NAMED}), c AS (SELECT run, mem.grp, mem.code, mem.selector, gp.name AS seen, status, count(*) AS n FROM gp JOIN mem ON gp.code = mem.code AND (selector = 'all' OR selector = band) GROUP BY ALL),
t AS (SELECT run, grp, code, selector, seen, string_agg(status || '=' || n, ';' ORDER BY status) AS counts FROM c GROUP BY ALL),
u AS (SELECT run, grp, code, name, string_agg(status || '=' || n, ';' ORDER BY status) AS counts FROM (SELECT run, grp, code, name, status, count(*) AS n FROM gp WHERE grp LIKE 'UNMAPPED-%' GROUP BY ALL) GROUP BY ALL)
SELECT run, grp AS "group", code AS configured_code, mem.name AS configured_name, selector, code AS observed_code, seen AS observed_name, coalesce(counts, '') AS counts, seen IS NOT NULL AND seen <> mem.name AS name_mismatch
FROM (SELECT DISTINCT run FROM r) CROSS JOIN mem LEFT JOIN t USING (run, grp, code, selector)
UNION ALL SELECT run, grp, NULL, NULL, NULL, code, name, counts, false FROM u""")
def a18_components(spark, sf_dir):
    """What each group's numbers are made of: members, the names they were observed under, and sectors that no group has."""
    rows, places, grouped, _ = _steps(spark, sf_dir)
    catalog = spark.sql(f"SELECT * FROM {_NAMED} AS c(`group`, code, name, selector)")
    out = coverage.components(places, catalog, rows, grouped.filter("policy IS NULL AND group IS NOT NULL"))
    said = F.array_join(F.transform(F.map_entries("status_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return out.select(*[c for c in out.columns if c not in ("status_counts", "name_mismatch")], said.alias("counts"), "name_mismatch")


_STATUS_COUNTS = "(SELECT run, grp, status, count(*) AS n FROM gp GROUP BY ALL)"


@q(f"""WITH {_HOURS}, m AS (SELECT gm2.*, run::DATE AS day, coalesce(CASE WHEN gm2.status = 'calculated' THEN occupied END, s.n, 0) AS n, CASE WHEN gm2.status = 'calculated' THEN occupied * 100.0 / capacity END AS share
FROM gm2 JOIN rc USING (run) LEFT JOIN {_STATUS_COUNTS} s ON s.run = gm2.run AND s.grp = gm2.grp AND s.status = 'occupied' WHERE unknown_age_rows = 0 AND conflict_positions = 0 AND unidentified_occupied_rows = 0)
SELECT day, grp AS "group", arg_min(policy, run) AS policy, arg_min(status, run) AS status, min(capacity) AS capacity, count(*) AS measurements, min(run) AS first_captured_at, max(run) AS last_captured_at,
round(avg(n), 2) AS mean_occupied, min(n) AS min_occupied, max(n) AS max_occupied, round(avg(share), 2) AS mean_pct, round(min(share), 2) AS min_pct, round(max(share), 2) AS max_pct, max(exceeded_by) AS max_exceeded_by
FROM m GROUP BY 1, 2""")
def a22_daily_groups(spark, sf_dir):
    rows, places, grouped, groups = _steps(spark, sf_dir, _HOURLY, _SMALL)
    bridge = ops.reconciliation(rows, places, grouped).select("run", "age_partial", "position_partial")
    measured = shown.with_status_counts(groups, grouped, ["run"]).join(bridge, "run").withColumn("day", F.to_date("run"))
    return shown.daily_groups(measured, "day", "run", ops.is_eligible(F.lit("occupancy-v3"), F.col("age_partial"), F.col("position_partial")))


@q(f"""WITH r AS (SELECT *, run::DATE AS day FROM ({_HOURLY.sql})), c AS (SELECT day, 'code' AS part, code AS key, name, status, count(*) AS n FROM r WHERE code <> '' GROUP BY ALL
UNION ALL SELECT day, 'band', code || '|' || band, name, status, count(*) FROM r WHERE code <> '' GROUP BY ALL UNION ALL SELECT day, 'blank', '', name, status, count(*) FROM r WHERE code = '' GROUP BY ALL),
m AS (SELECT day, part, key, name, string_agg(status || '=' || n, ';' ORDER BY status) AS t FROM c GROUP BY ALL) SELECT day, part, key, string_agg(name || ':' || t, '/' ORDER BY name) AS counters FROM m GROUP BY ALL""")
def a17_day_counters(spark, sf_dir):
    """Counters of hours merged into days, nested by code, name and status; here as texts."""
    counts = shown.observed_counts(_HOURLY.frame(spark, sf_dir), ["run"])
    nested = shown.nested_counters(shown.merged_counts(counts.withColumn("day", F.to_date("run")), ["day"]), ["day"])
    statuses = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    names = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(":"), statuses(e["value"]))), "/")
    of = lambda part, c: nested.select("day", F.lit(part).alias("part"), F.explode(c).alias("key", "m")).select("day", "part", "key", names(F.col("m")).alias("counters"))
    blank = nested.filter("blank_by_name IS NOT NULL").select("day", F.lit("blank").alias("part"), F.lit("").alias("key"), names(F.col("blank_by_name")).alias("counters"))
    return of("code", "by_code").union(of("band", "by_band")).union(blank)


@q(f"""WITH {_HOURS}, n AS (SELECT run, run::DATE AS day FROM (SELECT run, row_number() OVER (PARTITION BY run::DATE ORDER BY run DESC) AS k FROM (SELECT DISTINCT run FROM r)) WHERE k = 1),
b AS (SELECT r.*, CASE WHEN code = 'c3' AND status = 'occupied' AND band IN ('under_12', 'age_12_or_over') THEN CASE band WHEN 'under_12' THEN 'g2' ELSE 'g3' END WHEN code = 'c3' THEN 'AUX-3A-UNCLASSIFIED'
      WHEN code IN ('c1', 'c2') THEN 'g1' WHEN code = 'c4' THEN 'g4' END AS grp FROM r JOIN n USING (run)),
x AS (SELECT run, grp, count(*) AS beds, string_agg(id || ':' || status || ':' || CASE WHEN status = 'occupied' THEN record ELSE '' END, ',' ORDER BY id) AS shown, string_agg(DISTINCT name, ',' ORDER BY name) AS sectors FROM b WHERE grp IS NOT NULL GROUP BY 1, 2)
SELECT run, coalesce(g.grp, x.grp) AS "group", coalesce(policy, 'auxiliary') AS policy, CASE WHEN status = 'calculated' THEN occupied END AS occupied, pct, coalesce(beds, 0)::INTEGER AS beds, coalesce(shown, '') AS shown, coalesce(sectors, '') AS sectors
FROM (SELECT gm2.* FROM gm2 JOIN n USING (run)) g FULL JOIN x USING (run, grp)""")
def q09_group_presentation(spark, sf_dir):
    """The last capture of each day with its exact measurement: groups with their beds, and one row for beds of split codes that no group takes."""
    newest = lambda rows: rows.join(rows.groupBy(F.to_date("run").alias("census")).agg(F.max("run").alias("run")), "run")
    rows, _, grouped, groups = _steps(spark, sf_dir, _HOURLY, _SMALL, newest)
    measured = written(shown.with_status_counts(groups, grouped, ["run"]), "measured")  # as a run's measurement is: stored once, read by each view
    exact = shown.exact_measurement(rows, measured, "census")
    out = shown.group_presentation(rows.join(exact, "run", "left_semi"), _catalog(spark, _SMALL), measured.join(exact, "run", "left_semi"))
    said = F.array_join(F.transform("beds", lambda b: F.concat_ws(":", b["id"].cast("string"), b["status"], b["record"])), ",")
    return out.select("run", "group", "policy", "occupied", "pct", F.size("beds").alias("beds"), said.alias("shown"), F.array_join("source_sectors", ",").alias("sectors"))


@q(f"""WITH r AS ({_ROWS.sql}), k AS (SELECT *, upper(trim(bed)) AS b, CASE WHEN code <> '' THEN upper(code) ELSE upper(name) END AS source, CASE WHEN status = 'occupied' THEN status || '|' || upper(record) || '|' || band ELSE status END AS said FROM r),
p AS (SELECT run, source, b, count(*) AS n, count(DISTINCT said) > 1 AS conflict, arg_min(status, id) AS status, arg_min(record, id) AS record FROM k WHERE b <> '' GROUP BY ALL),
s AS (SELECT run, source, count(*) FILTER (NOT conflict AND status = 'occupied') AS occupied, count(*) FILTER (NOT conflict AND status = 'empty') AS empty, count(*) FILTER (conflict) AS conflict_positions, sum(CASE WHEN conflict THEN 0 ELSE n - 1 END)::BIGINT AS duplicate_extra_rows,
      string_agg(b || ':' || CASE WHEN conflict THEN 'conflict:' WHEN status = 'occupied' THEN 'occupied:' || record ELSE status || ':' END, ',' ORDER BY b) AS positions FROM p GROUP BY 1, 2),
f AS (SELECT run, source, arg_min(code, id) AS code, arg_min(name, id) AS name, count(*) FILTER (b = '') AS unidentified_rows FROM k GROUP BY 1, 2)
SELECT run, source, code, name, coalesce(occupied, 0) AS occupied, coalesce(empty, 0) AS empty, coalesce(conflict_positions, 0) AS conflict_positions, coalesce(duplicate_extra_rows, 0) AS duplicate_extra_rows, unidentified_rows, coalesce(positions, '') AS positions FROM f LEFT JOIN s USING (run, source)""")
def q10_sector_presentation(spark, sf_dir):
    out = shown.sector_presentation(_ROWS.frame(spark, sf_dir))
    said = F.array_join(F.transform("positions", lambda p: F.concat_ws(":", p["bed"], p["status"], p["record"])), ",")
    n = lambda s: F.coalesce(F.try_element_at("positions_by_status", F.lit(s)), F.lit(0)).alias(s)
    return out.select("run", "source", "code", "name", n("occupied"), n("empty"), "conflict_positions", "duplicate_extra_rows", "unidentified_rows", said.alias("positions"))


@q(f"""WITH {_SQL} SELECT run, grp AS "group", count(*) AS beds, count(*) FILTER (status = 'occupied') AS occupied, count(*) FILTER (status = 'empty') AS empty FROM gp GROUP BY 1, 2""")
def q09_q10_beds_by_group(spark, sf_dir):
    grouped = _steps(spark, sf_dir)[2]
    return grouped.groupBy("run", "group").agg(F.count("*").alias("beds"), F.count_if(F.col("status") == "occupied").alias("occupied"), F.count_if(F.col("status") == "empty").alias("empty"))


@q(f"WITH {_SQL} SELECT run, occupied_for_rate FROM ht WHERE run > DATE '2024-01-10'")
def u10_new_measurements(spark, sf_dir):
    totals = ops.hospital_totals(_steps(spark, sf_dir)[3])
    stored = totals.filter("run <= date'2024-01-10'")
    return ops.new_measurements(totals, stored).select("run", "occupied_for_rate")


_GROUPS = Binding(
    "part", "concat('g', CAST(p_partkey - CASE WHEN p_partkey % 50 = 1 THEN 1 ELSE 0 END AS STRING)) AS `group`",
    "CASE p_size % 3 WHEN 0 THEN 'standard' WHEN 1 THEN 'pending' ELSE 'unrated' END AS policy", "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size - 4 END AS capacity",
)
_MEMBERS = Binding(
    "part", "concat('g', CAST(p_partkey AS STRING)) AS `group`", "concat('c', CAST((p_partkey - p_partkey % 2) / 2 AS INT)) AS code",
    "CASE WHEN p_size % 9 = 0 THEN 'all' WHEN p_partkey % 2 = 0 THEN 'under_12' ELSE 'age_12_or_over' END AS selector", where="p_partkey % 7 <> 0",
)


@q(f"""WITH g AS ({_GROUPS.sql.replace("`", '"')}), m AS ({_MEMBERS.sql.replace("`", '"')}), u AS (SELECT code, list(selector ORDER BY selector) AS s, count(DISTINCT "group") AS n FROM m GROUP BY 1)
SELECT 'group_twice' AS rule, "group" AS key FROM g GROUP BY "group" HAVING count(*) > 1
UNION ALL SELECT 'policy_capacity', "group" FROM g WHERE (policy = 'standard' AND (capacity IS NULL OR capacity <= 0)) OR (policy <> 'standard' AND capacity <= 0)
UNION ALL SELECT 'code_selectors', code FROM u WHERE s <> ['all'] AND NOT (s = ['age_12_or_over', 'under_12'] AND n = 2)
UNION ALL SELECT DISTINCT 'group_without_code', "group" FROM g WHERE "group" NOT IN (SELECT "group" FROM m)""")
def v01_catalog_violations(spark, sf_dir):
    return ops.catalog_violations(_GROUPS.frame(spark, sf_dir), _MEMBERS.frame(spark, sf_dir))
