"""J01 to J17, O01 to O06, N01 to N08 and P01 to P14 on the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewell.functions import dates, strings
from tidewell.operators import lookups as ops
from tidewell.operators.places import placed
from tidewell.plans.registry import Binding, Registry
from tidewell.session import shared_folder, table
from tidewell.sources import files

q = Registry()
QUERIES, SQL = q.queries, q.sql

#: Orders as admissions of customers.
STAYS = Binding(
    "orders", "o_custkey AS patient", "o_orderkey AS admission", "CAST(o_orderdate AS DATE) AS started",
    "CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 120 AS INT) AS DATE) END AS ended",
)


@q("""SELECT c.c_custkey, c.c_name, n.n_name, r.r_name FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey""")
def j01_dimensions(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select("c_custkey", "c_name", "n_name", "r_name")


@q("""SELECT s_suppkey, coalesce(n_name, s_nationkey::VARCHAR) AS name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) ON n_nationkey = s_nationkey""")
def j02_name_or_code(spark, sf_dir):
    names = table(spark, sf_dir, "nation").filter("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("name"))
    return ops.with_name(table(spark, sf_dir, "supplier"), names, "s_nationkey", "name").select("s_suppkey", "name")


_raw = Binding("supplier", "s_suppkey", "CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_nationkey AS STRING) WHEN s_suppkey % 3 = 1 THEN 'FRANCE' ELSE 'nowhere' END AS raw")


@q(f"""SELECT s_suppkey, coalesce(a.n_name, b.n_name, raw) AS resolved FROM ({_raw.sql}) s LEFT JOIN nation a ON a.n_nationkey::VARCHAR = raw
LEFT JOIN (SELECT DISTINCT n_name FROM nation) b ON b.n_name = raw""")
def j03_code_or_name(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"))
    return ops.by_code_or_name(_raw.frame(spark, sf_dir), nation, "raw", "code", "name").select("s_suppkey", "resolved")


@q("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '2001-01-01')""")
def j04_with_recent(spark, sf_dir):
    recent = table(spark, sf_dir, "orders").filter("o_orderdate >= date'2001-01-01'")
    c = table(spark, sf_dir, "customer")
    return c.join(recent, c["c_custkey"] == recent["o_custkey"], "left_semi").select("c_custkey")


@q("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '2001-01-01')""")
def j05_without_recent(spark, sf_dir):
    recent = table(spark, sf_dir, "orders").filter("o_orderdate >= date'2001-01-01'")
    c = table(spark, sf_dir, "customer")
    return c.join(recent, c["c_custkey"] == recent["o_custkey"], "left_anti").select("c_custkey")


@q(f"""SELECT c_custkey, admission, started, ended FROM customer LEFT JOIN (SELECT * FROM ({STAYS.sql}) QUALIFY row_number() OVER
(PARTITION BY patient ORDER BY ended DESC NULLS FIRST, admission DESC) = 1) ON patient = c_custkey""")
def j06_w10_latest_stay(spark, sf_dir):
    last = ops.latest(STAYS.frame(spark, sf_dir), ["patient"], F.desc_nulls_first("ended"), F.desc("admission"))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return c.join(last, c["c_custkey"] == last["patient"], "left").drop("patient")


@q("SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS came_from FROM events")
def j07_previous_sector(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.lag("event_type").over(w).alias("came_from"))


_MOMENTS = "SELECT l_orderkey, l_linenumber, l_shipdate, o_custkey AS patient FROM lineitem JOIN orders ON o_orderkey = l_orderkey"


def _moments(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("moment"), F.col("o_custkey").alias("patient"))


_M = f"m AS (SELECT row_number() OVER () AS fact, l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS moment, patient FROM ({_MOMENTS})), s AS ({STAYS.sql})"


@q(f"""WITH {_M} SELECT l_orderkey, l_linenumber, moment, m.patient, arg_max(admission, (started, admission)) AS admission FROM m JOIN s
ON s.patient = m.patient AND started <= moment AND (ended IS NULL OR ended >= moment) GROUP BY fact, l_orderkey, l_linenumber, moment, m.patient""")
def j08_containing_stay(spark, sf_dir):
    return ops.containing(_moments(spark, sf_dir), STAYS.frame(spark, sf_dir), "patient", "moment", "started", "ended", "admission")


@q(f"""WITH {_M}, v AS (SELECT patient, started, max(admission) AS admission FROM s GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, moment, m.patient, v.admission FROM m ASOF LEFT JOIN v ON v.patient = m.patient AND m.moment >= v.started""")
def j09_as_of_backward(spark, sf_dir):
    return ops.as_of(_moments(spark, sf_dir), STAYS.frame(spark, sf_dir), ["patient"], "moment", "started", ["admission"])


@q(f"""WITH {_M}, v AS (SELECT patient, started, min(admission) AS admission FROM s GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, moment, m.patient, v.admission FROM m ASOF LEFT JOIN v ON v.patient = m.patient AND m.moment < v.started""")
def j10_as_of_forward(spark, sf_dir):
    return ops.as_of(_moments(spark, sf_dir), STAYS.frame(spark, sf_dir), ["patient"], "moment", "started", ["admission"], forward=True)


@q("""WITH v(since, version) AS (VALUES (DATE '2024-01-05', 1), (DATE '2024-01-12', 2), (DATE '2024-01-20', 3)), d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)
SELECT day, v.version FROM d ASOF LEFT JOIN v ON d.day >= v.since""")
def j11_as_of_version(spark, sf_dir):
    versions = spark.sql("SELECT * FROM VALUES (date'2024-01-05', 1), (date'2024-01-12', 2), (date'2024-01-20', 3) AS v(since, version)").withColumn("k", F.lit(0))
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct().withColumn("k", F.lit(0))
    return ops.as_of(days, versions, ["k"], "day", "since", ["version"]).drop("k")


@q(f"SELECT patient, admission FROM ({STAYS.sql}) WHERE started <= DATE '2000-06-30' AND coalesce(ended, DATE '2001-08-02') >= DATE '2000-06-01'")
def j12_overlapping(spark, sf_dir):
    first, last, today = (F.lit(d).cast("date") for d in ("2000-06-01", "2000-06-30", "2001-08-02"))
    return ops.overlapping(STAYS.frame(spark, sf_dir), "started", "ended", first, last, today).select("patient", "admission")


@q(f"""WITH s AS ({STAYS.sql}), o AS (SELECT patient, started, ended, min(admission) AS match FROM s WHERE admission % 2 = 0 GROUP BY ALL)
SELECT s.admission, match FROM s LEFT JOIN o ON o.patient = s.patient AND o.started = s.started AND o.ended IS NOT DISTINCT FROM s.ended""")
def j13_same_period(spark, sf_dir):
    s = STAYS.frame(spark, sf_dir)
    return ops.same_period(s, s.filter("admission % 2 = 0"), "patient", "started", "ended", "admission").select("admission", "match")


_ROWS = Binding("events", "event_id", "event_type AS code", "CASE WHEN value < 100 THEN 'under_12' WHEN value < 400 THEN 'age_12_or_over' ELSE 'unknown' END AS band", "concat('n', CAST(user_id % 5 AS STRING)) AS name")
_MEMBERS = "VALUES ('click', 'all', 'g1'), ('view', 'under_12', 'g2'), ('view', 'age_12_or_over', 'g3'), ('signup', 'all', 'g3')"


@q(f"""WITH m(code, selector, grp) AS ({_MEMBERS}) SELECT event_id, m.grp AS "group" FROM ({_ROWS.sql}) r JOIN m ON m.code = r.code AND (selector = 'all' OR selector = band)""")
def j14_code_and_band(spark, sf_dir):
    members = spark.sql(f"SELECT * FROM {_MEMBERS} AS m(code, selector, `group`)")
    return ops.by_code_and_band(_ROWS.frame(spark, sf_dir), members).select("event_id", "group")


@q(f"""WITH {_M}, s2 AS (SELECT patient, admission, CASE WHEN admission % 10 = 0 THEN NULL ELSE started END AS started, ended FROM s),
c AS (SELECT m.fact, m.l_orderkey, m.l_linenumber, m.moment, m.patient, admission, CASE WHEN admission = l_orderkey AND l_linenumber = 1 THEN 1 WHEN started <= moment AND (ended IS NULL OR ended >= moment) THEN 2
WHEN started <= moment THEN 3 WHEN started > moment THEN 4 ELSE 5 END AS step, abs(date_diff('day', started, moment)) AS near FROM m LEFT JOIN s2 ON s2.patient = m.patient)
SELECT l_orderkey, l_linenumber, arg_min(admission, (step, CASE WHEN step IN (1, 5) THEN 0 ELSE near END, admission)) AS admission, min(step)::INTEGER AS step FROM c GROUP BY fact, l_orderkey, l_linenumber""")
def j15_resolved(spark, sf_dir):
    facts = _moments(spark, sf_dir).withColumn("wanted", F.when(F.col("l_linenumber") == 1, F.col("l_orderkey")))
    spans = STAYS.frame(spark, sf_dir).withColumn("started", F.when(F.col("admission") % 10 != 0, F.col("started")))
    return ops.resolved(facts, spans, "patient", "moment", "started", "ended", "admission", "wanted").select("l_orderkey", "l_linenumber", "admission", "step")


@q("""SELECT c_custkey AS o_custkey, count(o_orderkey) AS n, count(DISTINCT l_orderkey) AS with_lines, count(o_orderkey) - count(DISTINCT l_orderkey) AS without_lines
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey GROUP BY 1""")
def j16_a06_child_counts(spark, sf_dir):
    parents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    children = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return ops.with_child_counts(parents, children, "o_custkey", "o_orderkey", lines, ("n", "with_lines", "without_lines"))


_COMPONENTS = "VALUES ('click', CAST(NULL AS STRING), 'a', 'g1'), ('view', 'under_12', 'b', 'g2'), ('view', 'age_12_or_over', 'b', 'g3'), ('', CAST(NULL AS STRING), 'n1', 'g4')"
_BLANKED = Binding("events", "event_id", "CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS code", _ROWS.columns[2], _ROWS.columns[3])


@q(f"""WITH c(code, band, name, grp) AS ({_COMPONENTS}) SELECT event_id, coalesce(x.grp, y.grp, z.grp) AS "group" FROM ({_BLANKED.sql}) r
LEFT JOIN c x ON x.code = r.code AND x.band = r.band LEFT JOIN c y ON y.code = r.code AND y.band IS NULL AND y.code <> ''
LEFT JOIN c z ON z.code = '' AND r.code = '' AND z.name = r.name WHERE coalesce(x.grp, y.grp, z.grp) IS NOT NULL""")
def j17_reverse_mapped(spark, sf_dir):
    parts = spark.sql(f"SELECT * FROM {_COMPONENTS} AS c(code, band, name, `group`)")
    return ops.reverse_mapped(_BLANKED.frame(spark, sf_dir), parts).select("event_id", "group")


@q("""SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1998-03-01' AND o_orderdate < DATE '1998-04-01' AND o_orderstatus IN ('F', 'O') AND o_orderpriority IS NOT NULL
AND NOT (o_totalprice < 1000)""")
def p01_p03_p07_filters(spark, sf_dir):
    c = F.col
    keep = dates.in_days(c("o_orderdate"), "1998-03-01", "1998-03-31") & c("o_orderstatus").isin("F", "O") & c("o_orderpriority").isNotNull() & ~(c("o_totalprice") < 1000)
    return table(spark, sf_dir, "orders").filter(keep).select("o_orderkey")


@q("SELECT c_custkey FROM customer WHERE contains(upper(c_name), '99') OR contains(upper(c_mktsegment), 'BUILD')")
def p02_name_or_record(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter(strings.contains_text(F.col("c_name"), "99") | strings.contains_text(F.col("c_mktsegment"), "build")).select("c_custkey")


@q("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def p08_json_predicate(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(F.get_json_object("props", "$.k") == "7").select("event_id")


@q("SELECT DISTINCT source FROM documents")
def p09_distinct_values(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source").distinct().orderBy("source")


@q("SELECT event_id, user_id FROM events WHERE date_trunc('hour', ts) = (SELECT max(date_trunc('hour', ts)) FROM events) AND event_type IN ('click', 'view', 'error')")
def p10_p11_latest_snapshot(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("captured_at", F.date_trunc("hour", "ts"))
    newest = events.agg(F.max("captured_at").alias("newest"))
    return events.join(F.broadcast(newest), F.col("captured_at") == F.col("newest")).filter("event_type IN ('click', 'view', 'error')").select("event_id", "user_id")


@q("""SELECT count(*) AS stale FROM orders WHERE coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END, o_orderdate - INTERVAL 5 DAY) < DATE '1996-01-01'""")
def p13_stale_count(spark, sf_dir):
    start = F.coalesce(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")), F.col("o_orderdate") - F.expr("interval 5 days"))
    return table(spark, sf_dir, "orders").filter(start < F.lit("1996-01-01").cast("date")).agg(F.count("*").alias("stale"))


@q("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND (o_orderkey % 4 = 0 OR o_orderdate <= DATE '1999-01-01') ORDER BY o_orderkey LIMIT 1""")
def p14_next_eligible(spark, sf_dir):
    retry = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate"))
    eligible = table(spark, sf_dir, "orders").filter((F.col("o_orderstatus") == "O") & (retry.isNull() | (retry <= F.lit("1999-01-01").cast("date"))))
    return eligible.orderBy("o_orderkey").limit(1).select("o_orderkey")


@q("""SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_mktsegment, coalesce(try_cast(nullif(regexp_replace(c_name, '\\D', '', 'g'), '') AS INT), 0) DESC, c_custkey) AS place FROM customer""")
def o01_o02_o06_orders(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("number", strings.number_in(F.col("c_name")))
    places = placed(rows, [F.col("c_mktsegment"), F.desc("number"), F.col("c_custkey")])
    return places.select("c_custkey", "c_name", (F.col("place") + 1).alias("place"))


@q("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def o03_top_rows(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@q("SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET (((SELECT count(*) FROM customer) - 1) // 40) * 40 LIMIT 40")
def o04_page(spark, sf_dir):
    """A page past the end of a table of any size."""
    from tidewell.operators.pages import page

    return page(table(spark, sf_dir, "customer").select("c_custkey"), str(2**63 - 1), 40, "c_custkey")


@q("""SELECT DISTINCT c.c_nationkey FROM customer c WHERE c_acctbal > 5000 AND c.c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)""")
def n01_n02_n03_set_difference(spark, sf_dir):
    seen = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select("c_nationkey").distinct()
    known = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("c_nationkey"))
    return seen.join(known, "c_nationkey", "left_anti")


@q("""WITH a AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS entries FROM events WHERE value < 50 GROUP BY 1, 2),
b AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS exits FROM events WHERE value > 450 GROUP BY 1, 2)
SELECT event_type, day, coalesce(entries, 0) AS entries, coalesce(exits, 0) AS exits FROM a FULL JOIN b USING (event_type, day)""")
def n08_key_union(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    a = events.filter("value < 50").groupBy("event_type", "day").agg(F.count("*").alias("entries"))
    b = events.filter("value > 450").groupBy("event_type", "day").agg(F.count("*").alias("exits"))
    return a.join(b, ["event_type", "day"], "full").fillna(0, ["entries", "exits"])


@q("""WITH e AS (SELECT *, date_trunc('hour', ts) AS captured FROM events) SELECT event_type AS sector, user_id::VARCHAR AS bed, event_id::VARCHAR AS event_id FROM e WHERE captured = (SELECT max(captured) FROM e)""")
def s24_latest_snapshot_csv(spark, sf_dir):
    """The latest snapshot as a report in order of sector and bed, read back."""
    events = table(spark, sf_dir, "events").withColumn("captured_at", F.date_trunc("hour", "ts"))
    newest = F.broadcast(events.agg(F.max("captured_at").alias("newest")))  # one row
    rows = events.join(newest, F.col("captured_at") == F.col("newest")).select(F.col("event_type").alias("sector"), F.col("user_id").alias("bed"), "event_id")
    path = f"{shared_folder(spark)}/tidewell/report-{uuid.uuid4().hex}"
    files.write_report(rows, path, "sector", "bed", "event_id")
    return spark.read.csv(path, header=True, schema="sector string, bed string, event_id string")
