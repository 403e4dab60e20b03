"""U01 to U20 on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import ledger as ops
from tidewell.plans.lookups import STAYS
from tidewell.plans.registry import Binding, Registry
from tidewell.session import table

q = Registry()
QUERIES, SQL = q.queries, q.sql

_EVENTS = Binding("events", "event_id", "concat(CAST(user_id AS STRING), '|', CAST(CAST(ts AS DATE) AS STRING)) AS identity", "event_type AS content", "event_id % 3 = 0 AS stored")


@q(f"""WITH e AS ({_EVENTS.sql}), l AS (SELECT DISTINCT identity, content FROM e WHERE stored), b AS (SELECT * FROM e WHERE NOT stored),
n AS (SELECT *, row_number() OVER (PARTITION BY identity, content ORDER BY event_id) AS nth, (identity, content) IN (SELECT (identity, content) FROM l) AS exact,
identity IN (SELECT identity FROM l) AS known FROM b),
f AS (SELECT *, min(CASE WHEN NOT exact AND nth = 1 THEN event_id END) OVER (PARTITION BY identity) AS first_new FROM n)
SELECT event_id, CASE WHEN exact OR nth > 1 THEN 'skipped' WHEN NOT known AND event_id = first_new THEN 'created' ELSE 'revised' END AS action FROM f""")
def u01_ledger_actions(spark, sf_dir):
    rows = _EVENTS.frame(spark, sf_dir)
    return ops.ledger_actions(rows.filter("NOT stored"), rows.filter("stored"), "event_id").select("event_id", "action")


@q("""WITH s AS (SELECT c_custkey AS k, c_mktsegment AS name FROM customer WHERE c_custkey % 3 > 0), i AS (SELECT o_custkey AS k, max_by(o_orderpriority, o_orderkey) FILTER (o_orderkey % 5 > 0) AS new FROM orders GROUP BY 1)
SELECT i.k, s.name AS old, i.new, CASE WHEN s.k IS NULL THEN 'created' WHEN i.new IS NOT NULL AND i.new <> s.name THEN 'renamed' ELSE 'kept' END AS action FROM i LEFT JOIN s ON s.k = i.k""")
def u02_get_or_create(spark, sf_dir):
    stored = Binding("customer", "c_custkey AS k", "c_mktsegment AS name", where="c_custkey % 3 > 0").frame(spark, sf_dir)
    incoming = Binding("orders", "o_custkey AS k", "CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority ELSE '' END AS name", "o_orderkey").frame(spark, sf_dir)
    return ops.get_or_create(stored, incoming, "k", "name", "o_orderkey")


_OLD = Binding("customer", "c_custkey AS k", "c_mktsegment AS a", "CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END AS b", where="c_custkey % 5 > 0")
_NEW = Binding("customer", "c_custkey AS k", "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS a", "CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE c_name END AS b", where="c_custkey % 4 > 0")


@q(f"""SELECT k, coalesce(nullif(n.a, ''), o.a, '') AS a, coalesce(nullif(n.b, ''), o.b, '') AS b FROM ({_OLD.sql}) o FULL JOIN ({_NEW.sql}) n USING (k)""")
def u03_filled_over(spark, sf_dir):
    return ops.filled_over(_OLD.frame(spark, sf_dir), _NEW.frame(spark, sf_dir), "k", ["a", "b"])


@q(f"""SELECT k, field, old, new FROM (SELECT k, 'a' AS field, o.a AS old, n.a AS new FROM ({_OLD.sql}) o JOIN ({_NEW.sql}) n USING (k)
UNION ALL SELECT k, 'b', o.b, n.b FROM ({_OLD.sql}) o JOIN ({_NEW.sql}) n USING (k)) WHERE old <> '' AND new <> '' AND old <> new""")
def u03_audit(spark, sf_dir):
    return ops.changes(_OLD.frame(spark, sf_dir), _NEW.frame(spark, sf_dir), "k", ["a", "b"])


@q(f"""WITH s AS (SELECT * FROM ({STAYS.sql}) WHERE admission % 2 = 0), i AS (SELECT patient, CASE WHEN admission % 3 = 0 THEN -admission ELSE admission END AS admission, started, ended FROM ({STAYS.sql})),
p AS (SELECT patient, started, ended, min(admission) AS p FROM s GROUP BY ALL)
SELECT i.patient, i.admission, coalesce(s.admission, p.p, i.admission) AS target, CASE WHEN s.admission IS NOT NULL THEN 'by_key' WHEN p.p IS NOT NULL THEN 'by_period' ELSE 'created' END AS action
FROM i LEFT JOIN s ON s.patient = i.patient AND s.admission = i.admission LEFT JOIN p ON p.patient = i.patient AND p.started = i.started AND p.ended IS NOT DISTINCT FROM i.ended""")
def u04_reconciled(spark, sf_dir):
    stays = STAYS.frame(spark, sf_dir)
    incoming = stays.withColumn("admission", F.when(F.col("admission") % 3 == 0, -F.col("admission")).otherwise(F.col("admission")))
    return ops.reconciled(incoming, stays.filter("admission % 2 = 0"), "patient", "admission", "started", "ended").select("patient", "admission", "target", "action")


_DOUBLE = Binding("orders", "o_custkey AS patient", "o_orderkey AS admission", "CASE WHEN o_orderstatus = 'O' THEN NULL ELSE year(o_orderdate) END AS period", "o_orderkey % 5 AS events")


@q(f"""SELECT admission, first_value(admission) OVER (PARTITION BY patient, period ORDER BY events DESC, admission) AS survivor FROM ({_DOUBLE.sql})""")
def u05_survivors(spark, sf_dir):
    return ops.survivors(_DOUBLE.frame(spark, sf_dir), ["patient", "period"], "admission", "events")


@q(f"""WITH m AS (SELECT admission, first_value(admission) OVER (PARTITION BY patient, period ORDER BY events DESC, admission) AS survivor FROM ({_DOUBLE.sql}))
SELECT survivor AS l_orderkey, count(*) AS n FROM lineitem JOIN m ON admission = l_orderkey GROUP BY 1""")
def u05_u13_repointed(spark, sf_dir):
    moves = ops.survivors(_DOUBLE.frame(spark, sf_dir), ["patient", "period"], "admission", "events")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    return ops.repointed(lines, moves, "l_orderkey", "admission", "survivor").groupBy("l_orderkey").agg(F.count("*").alias("n"))


_PARTS = Binding("events", "event_id", "CAST(ts AS DATE) AS day", "value")


@q(f"""WITH e AS ({_PARTS.sql}), i AS (SELECT event_id, day, value * 2 AS value FROM e WHERE day(day) % 3 = 0 AND event_id % 2 = 0)
SELECT * FROM e WHERE day NOT IN (SELECT day FROM i) UNION ALL SELECT * FROM i""")
def u06_u11_u16_u20_replaced(spark, sf_dir):
    rows = _PARTS.frame(spark, sf_dir)
    incoming = rows.filter("day(day) % 3 = 0 AND event_id % 2 = 0").withColumn("value", F.col("value") * 2)
    return ops.replaced(rows, incoming, "day")


@q("""SELECT user_id, event_type AS sector, CAST(ts AS DATE) AS day, min(ts) AS first_seen_at, max(ts) AS last_seen_at, arg_min(event_id, (ts, event_id)) AS origin FROM events GROUP BY 1, 2, 3""")
def u07_movements(spark, sf_dir):
    rows = Binding("events", "user_id", "event_type AS sector", "CAST(ts AS DATE) AS day", "ts", "event_id AS origin").frame(spark, sf_dir)
    early = rows.filter("hour(ts) < 9")
    keys = ["user_id", "sector", "day"]
    stored = ops.first_seen_upsert(spark.createDataFrame([], "user_id long, sector string, day date, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, origin long"), early, keys, "ts")
    return ops.first_seen_upsert(stored, rows.filter("hour(ts) >= 9"), keys, "ts")


_STORED = Binding("orders", "o_orderkey AS k", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS a", "o_orderpriority AS b", where="o_orderkey % 3 > 0")
_INCOMING = Binding("orders", "o_orderkey AS k", "CASE WHEN o_orderkey % 5 = 0 THEN 'Z' ELSE NULL END AS a", "CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority END AS b", where="o_orderkey % 2 = 0")


@q(f"""SELECT k, coalesce(n.a, o.a) AS a, coalesce(n.b, o.b) AS b, CASE WHEN o.k IS NULL THEN 'inserted' WHEN (n.a IS NOT NULL AND n.a IS DISTINCT FROM o.a) OR (n.b IS NOT NULL AND n.b IS DISTINCT FROM o.b)
THEN 'updated' ELSE 'unchanged' END AS action FROM ({_STORED.sql}) o FULL JOIN ({_INCOMING.sql}) n USING (k)""")
def u08_u17_updated(spark, sf_dir):
    return ops.updated(_STORED.frame(spark, sf_dir), _INCOMING.frame(spark, sf_dir), ["k"], ["a", "b"])


@q(f"""WITH n AS (SELECT patient, arg_max(admission, (started, admission)) AS admission FROM ({STAYS.sql}) GROUP BY 1), s AS (SELECT n.*, t.ended FROM n JOIN ({STAYS.sql}) t USING (patient, admission))
SELECT c_custkey AS record, s.admission, CASE WHEN c_custkey % 6 = 0 THEN 'create_patient' WHEN s.patient IS NULL THEN 'create_stay' WHEN s.ended IS NOT NULL THEN 'already_closed' ELSE 'close' END AS action
FROM customer LEFT JOIN s ON s.patient = c_custkey AND c_custkey % 6 > 0""")
def u09_closures(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    reports = c.select(F.col("c_custkey").alias("record"))
    patients = c.filter("c_custkey % 6 > 0").select(F.col("c_custkey").alias("record"), F.col("c_custkey").alias("patient"))
    return ops.closures(reports, STAYS.frame(spark, sf_dir), patients).select("record", "admission", "action")


@q(f"""WITH s AS ({STAYS.sql}), x AS (SELECT s.*, 'w0' AS ward, 'b0' AS bed, admission = max_by(admission, (started, admission)) FILTER (ended IS NULL) OVER (PARTITION BY patient) AS newest FROM s),
p AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS w, c_name AS b FROM customer WHERE c_custkey % 4 > 0)
SELECT admission, CASE WHEN ended IS NULL AND newest AND coalesce(w, '') <> '' THEN w ELSE ward END AS ward, CASE WHEN ended IS NULL AND newest AND coalesce(b, '') <> '' THEN b ELSE bed END AS bed
FROM x LEFT JOIN p ON c_custkey = patient""")
def u12_located(spark, sf_dir):
    stays = STAYS.frame(spark, sf_dir).withColumns({"ward": F.lit("w0"), "bed": F.lit("b0")})
    places = Binding("customer", "c_custkey AS patient", "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS ward", "c_name AS bed", where="c_custkey % 4 > 0").frame(spark, sf_dir)
    return ops.located(stays, places, "patient", only_newest=True).select("admission", "ward", "bed")


@q("""SELECT user_id, min(CAST(ts AS DATE)) AS coverage_start, max(CAST(ts AS DATE)) + 1 AS coverage_end FROM events GROUP BY 1""")
def u14_widened(spark, sf_dir):
    rows = Binding("events", "user_id", "CAST(ts AS DATE) AS coverage_start", "CAST(CAST(ts AS DATE) + 1 AS DATE) AS coverage_end", "event_id").frame(spark, sf_dir)
    return ops.widened(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1"), "user_id")


@q("SELECT c_custkey AS k, arg_max(o_orderkey, o_orderkey) AS version FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON o_custkey = c_custkey GROUP BY 1")
def u15_restored(spark, sf_dir):
    versions = Binding("orders", "o_custkey AS k", "o_orderkey AS created", "o_orderkey AS version", where="o_orderstatus = 'F'").frame(spark, sf_dir)
    return ops.restored(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), versions, "k", "created", "version")


_QUEUE = Binding(
    "orders", "o_orderkey AS run", "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_custkey END AS batch", "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'running' ELSE 'queued' END AS status",
    "o_orderkey % 5 AS attempts", "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END AS record", "CAST(o_orderdate AS DATE) AS queued_at",
)


@q(f"""SELECT run FROM ({_QUEUE.sql}) WHERE status = 'failed' AND attempts >= 3 AND batch IS NOT NULL AND record <> '' AND run % 10 <> 3""")
def u18_final_failures(spark, sf_dir):
    runs = _QUEUE.frame(spark, sf_dir)
    return ops.final_failures(runs, runs.filter("run % 10 = 3"), 3).select("run")


@q(f"""WITH n AS (SELECT max(c_custkey) AS newest FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'))
SELECT run, CASE WHEN status = 'running' AND batch = newest THEN 'queued' ELSE status END AS status, CASE WHEN status = 'running' AND batch = newest THEN DATE '2001-09-01' ELSE queued_at END AS queued_at
FROM ({_QUEUE.sql}), n""")
def u19_requeued(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    batches = orders.groupBy(F.col("o_custkey").alias("batch")).agg(F.when(F.bool_and(F.col("o_orderstatus") != "O"), F.lit(1)).alias("finished")).withColumn("opened", F.lit(0))
    return ops.requeued(_QUEUE.frame(spark, sf_dir), batches, F.lit("2001-09-01").cast("date")).select("run", "status", "queued_at")


_MERGES = f"""m AS (SELECT admission, first_value(admission) OVER (PARTITION BY patient, period ORDER BY events DESC, admission) AS survivor FROM ({_DOUBLE.sql})),
n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)"""


@q(f"WITH {_MERGES} SELECT admission, survivor, coalesce(n, 0) AS moved FROM m LEFT JOIN n ON l_orderkey = admission WHERE admission <> survivor")
def u13_merge_audit(spark, sf_dir):
    moves = ops.survivors(_DOUBLE.frame(spark, sf_dir), ["patient", "period"], "admission", "events").select("admission", "survivor")
    stays = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("admission"))
    return ops.merged(stays, table(spark, sf_dir, "lineitem").select("l_orderkey"), moves, "admission", "l_orderkey", "admission", "survivor")[2]


@q(f"WITH {_MERGES} SELECT survivor AS admission, sum(coalesce(n, 0))::BIGINT AS children FROM m LEFT JOIN n ON l_orderkey = admission GROUP BY 1")
def u13_merged(spark, sf_dir):
    """What remains after the merge, with the children that point at it."""
    moves = ops.survivors(_DOUBLE.frame(spark, sf_dir), ["patient", "period"], "admission", "events").select("admission", "survivor")
    stays = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("admission"))
    left, children, _ = ops.merged(stays, table(spark, sf_dir, "lineitem").select("l_orderkey"), moves, "admission", "l_orderkey", "admission", "survivor")
    counts = children.groupBy(F.col("l_orderkey").alias("admission")).agg(F.count("*").alias("n"))
    return left.join(counts, "admission", "left").select("admission", F.coalesce("n", F.lit(0)).alias("children"))


@q("""SELECT user_id, day, attempts, CASE WHEN attempts < 3 THEN 'queued' ELSE 'failed' END AS status, CASE WHEN attempts < 3 THEN last + INTERVAL 60 SECOND END AS next_retry_at
FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS attempts, max(ts) AS last FROM events WHERE event_type = 'error' GROUP BY 1, 2)""")
def z03_retried(spark, sf_dir):
    """Errors of a user and day as the attempts of a run."""
    errors = table(spark, sf_dir, "events").filter("event_type = 'error'")
    runs = errors.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("attempts"), F.max("ts").alias("last"))
    return ops.retried(runs, "attempts", "last").drop("last")
