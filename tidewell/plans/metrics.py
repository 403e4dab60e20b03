"""A01 to A32 on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions.amounts import reported_or_estimated
from tidewell.functions.classes import residual_quality
from tidewell.operators import metrics as ops
from tidewell.operators.lookups import latest
from tidewell.operators.series import stays
from tidewell.plans.registry import Binding, Registry
from tidewell.session import table

q = Registry()
QUERIES, SQL = q.queries, q.sql
_KINDS = ["click", "error", "purchase", "signup", "view"]


@q("SELECT max(ts) AS newest, count(*) AS n, count(*) FILTER (event_type = 'error') > 0 AS any_error FROM events")
def a01_totals(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.max("ts").alias("newest"), F.count("*").alias("n"), F.bool_or(F.col("event_type") == "error").alias("any_error"))


@q("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in _KINDS) + ", count(*) FILTER (event_type = 'none') AS none FROM events GROUP BY 1")
def a02_a14_dense_counts(spark, sf_dir):
    return ops.dense_counts(table(spark, sf_dir, "events"), ["user_id"], "event_type", [*_KINDS, "none"])


@q("SELECT event_type, " + ", ".join(f"count(*) FILTER (hour(ts) = {h}) AS h{h}" for h in range(24)) + " FROM events GROUP BY 1")
def a03_hours_by_kind(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("h", F.concat(F.lit("h"), F.hour("ts")))
    return ops.dense_counts(rows, ["event_type"], "h", [f"h{h}" for h in range(24)])


@q("""SELECT event_type, count(*) AS total, count(*) FILTER (hour(ts) >= 16) AS late, count(*) FILTER (hour(ts) >= 16) * 100.0::DOUBLE / count(*) AS pct
FROM events GROUP BY 1 ORDER BY pct DESC, event_type""")
def a04_share_after(spark, sf_dir):
    return ops.share_after(table(spark, sf_dir, "events"), "event_type", F.hour("ts"), 16).orderBy(F.desc("pct"), "event_type")


@q("""SELECT CAST(h AS DATE) AS day, avg(n) AS adc, count(*) AS captures FROM (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events
WHERE event_type = 'view' GROUP BY 1) GROUP BY 1""")
def a05_two_levels(spark, sf_dir):
    from tidewell.operators.flow import average_daily_census

    return average_daily_census(table(spark, sf_dir, "events"), F.date_trunc("hour", "ts"), F.col("event_type") == "view")


@q("SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS patients FROM events WHERE event_type = 'purchase' GROUP BY 1")
def a07_patients_a_day(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("event_type = 'purchase'").groupBy(F.to_date("ts").alias("day")).agg(F.count_distinct("user_id").alias("patients"))


@q("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE isodow(ts) <> 3 GROUP BY 1)
SELECT w::INTEGER AS weekday, coalesce(avg(n), 0.0) AS mean, count(n) AS days FROM range(7) t(w) LEFT JOIN d ON isodow(day) - 1 = w GROUP BY 1""")
def a08_weekday_means(spark, sf_dir):
    days = table(spark, sf_dir, "events").filter("weekday(ts) <> 2").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return ops.weekday_means(days, "day", "n")


_RUNS = Binding(
    "orders", "o_orderkey AS run", "o_custkey AS batch", "CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' ELSE 'failed' END AS status",
    "o_orderkey % 13 = 0 AS timed_out", "concat(o_orderpriority, ':', CAST(o_orderkey % 4 AS STRING)) AS worker", "o_orderpriority AS intent", "CAST(o_orderdate AS DATE) AS started",
    "CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INT) END AS finished",
)
_SECONDS = "date_diff('day', started, finished) * 86400.0"
_RUN_SQL = f"""count(*) AS total, count(*) FILTER (status = 'succeeded') * 100.0::DOUBLE / count(*) AS success_pct, count(*) FILTER (timed_out) * 100.0::DOUBLE / count(*) AS timeout_pct,
avg({_SECONDS}::DOUBLE) AS mean_seconds, min({_SECONDS}::DOUBLE) AS min_seconds, max({_SECONDS}::DOUBLE) AS max_seconds"""


@q(f"SELECT {_RUN_SQL} FROM ({_RUNS.sql})")
def a09_run_metrics(spark, sf_dir):
    return ops.run_metrics(_RUNS.frame(spark, sf_dir), [])


@q(f"SELECT split_part(worker, ':', 1) AS pool, {_RUN_SQL} FROM ({_RUNS.sql}) GROUP BY 1")
def a15_metrics_by_pool(spark, sf_dir):
    return ops.run_metrics(_RUNS.frame(spark, sf_dir).withColumn("pool", F.split_part("worker", F.lit(":"), F.lit(1))), ["pool"])


@q(f"""WITH b AS (SELECT batch, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'running') AS running,
array_to_string(list_sort(list(DISTINCT worker)), ',') AS workers, sum({_SECONDS})::DOUBLE AS busy, (date_diff('day', min(started), max(finished)) * 86400)::DOUBLE AS drain_seconds
FROM ({_RUNS.sql}) GROUP BY 1)
SELECT batch, succeeded, failed, running, workers, drain_seconds, CASE WHEN drain_seconds > 0 THEN (succeeded + failed) / (drain_seconds / 60) ELSE 0 END AS throughput,
CASE WHEN drain_seconds > 0 THEN busy / drain_seconds ELSE 0 END AS mean_concurrency FROM b""")
def a10_a11_a12_batch_metrics(spark, sf_dir):
    return ops.batch_metrics(_RUNS.frame(spark, sf_dir), "batch")


@q(f"SELECT intent, count(*) AS failures FROM ({_RUNS.sql}) WHERE status = 'failed' GROUP BY 1")
def a13_failures_by_intent(spark, sf_dir):
    return _RUNS.frame(spark, sf_dir).filter("status = 'failed'").groupBy("intent").agg(F.count("*").alias("failures"))


@q("SELECT count(DISTINCT nullif(trim(source), '')) >= 40 AS complete, count(DISTINCT nullif(trim(source), '')) AS sectors FROM documents")
def a16_completeness(spark, sf_dir):
    sectors = F.count_distinct(F.nullif(F.trim("source"), F.lit("")))
    return table(spark, sf_dir, "documents").agg((sectors >= 40).alias("complete"), sectors.alias("sectors"))


@q("""WITH c AS (SELECT date_trunc('hour', ts) AS captured_at, sum(value) AS v, count(*) AS n FROM events GROUP BY 1)
SELECT CAST(captured_at AS DATE) AS day, count(*) AS measurements, count(*) FILTER (n >= 12) AS eligible, avg(v) FILTER (n >= 12) AS mean, min(v) FILTER (n >= 12) AS low,
max(v) FILTER (n >= 12) AS high, min(captured_at) AS first_captured_at, max(captured_at) AS last_captured_at FROM c GROUP BY 1""")
def a21_daily_summary(spark, sf_dir):
    captures = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("captured_at")).agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    return ops.eligible_summary(captures.withColumn("day", F.to_date("captured_at")), "day", F.col("n") >= 12, "v")


@q("""SELECT user_id, CASE WHEN sum(r) > 0 THEN sum(r) ELSE sum(e) END AS cost FROM (SELECT user_id, CASE WHEN event_type = 'purchase' THEN event_id END AS r, event_id % 100 AS e FROM events) GROUP BY 1""")
def a23_costs(spark, sf_dir):
    reported = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(reported_or_estimated(reported, F.col("event_id") % 100).alias("cost"))


_STAY = """SELECT user_id, event_type, greatest(date_diff('day', CAST(ts AS DATE), coalesce(lead(CAST(ts AS DATE)) OVER (PARTITION BY user_id ORDER BY ts, event_id), DATE '2024-02-05')), 0) AS stay,
lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL AS present FROM events"""


def _stays(spark, sf_dir):
    rows = Binding("events", "event_id", "user_id", "event_type", "ts", "CAST(ts AS DATE) AS day").frame(spark, sf_dir)
    return stays(rows, "user_id", "day", ["ts", "event_id"], F.lit("2024-02-05").cast("date"))


@q(f"SELECT event_type, avg(stay) AS mean_stay FROM ({_STAY}) GROUP BY 1")
def a24_mean_stay(spark, sf_dir):
    return _stays(spark, sf_dir).groupBy("event_type").agg(F.avg("stay").alias("mean_stay"))


@q("""SELECT event_type AS came_to, n FROM (SELECT event_type, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS came_from FROM events)
WHERE came_from = 'view' GROUP BY 1) ORDER BY n DESC, came_to LIMIT 10""")
def a25_destinations(spark, sf_dir):
    from pyspark.sql import Window

    came_from = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    moves = table(spark, sf_dir, "events").withColumn("came_from", came_from).filter("came_from = 'view'")
    return moves.groupBy(F.col("event_type").alias("came_to")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "came_to").limit(10)


@q(f"""SELECT event_type, count(*) FILTER (present AND stay > 6) AS long_stays, count(*) FILTER (present) AS still_in, count(*) FILTER (NOT present) AS left_it, avg(stay) FILTER (present) AS days_since_entry
FROM ({_STAY}) GROUP BY 1""")
def a26_a28_present_and_long_stays(spark, sf_dir):
    here = F.col("is_active")
    return _stays(spark, sf_dir).groupBy("event_type").agg(
        F.count_if(here & (F.col("stay") > 6)).alias("long_stays"), F.count_if(here).alias("still_in"), F.count_if(~here).alias("left_it"), F.avg(F.when(here, F.col("stay"))).alias("days_since_entry")
    )


@q("""WITH a AS (SELECT event_type, count(*) AS entries FROM events WHERE value < 250 GROUP BY 1), b AS (SELECT event_type, count(*) AS exits FROM events WHERE value >= 250 AND event_type <> 'error' GROUP BY 1)
SELECT event_type, coalesce(entries, 0) - coalesce(exits, 0) AS waiting FROM a FULL JOIN b USING (event_type) WHERE coalesce(entries, 0) - coalesce(exits, 0) > 0""")
def a27_bottlenecks(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    a = events.filter("value < 250").groupBy("event_type").agg(F.count("*").alias("entries"))
    b = events.filter("value >= 250 AND event_type <> 'error'").groupBy("event_type").agg(F.count("*").alias("exits"))
    waiting = F.coalesce("entries", F.lit(0)) - F.coalesce("exits", F.lit(0))
    return a.join(b, "event_type", "full").select("event_type", waiting.alias("waiting")).filter("waiting > 0")


@q("""WITH t AS (SELECT * FROM events WHERE value > 480 ORDER BY ts DESC, event_id DESC LIMIT 50)
SELECT user_id, count(*) AS hits, string_agg(event_id::VARCHAR, ',' ORDER BY ts DESC, event_id DESC) AS event_ids FROM t GROUP BY 1""")
def a29_grouped_hits(spark, sf_dir):
    top = table(spark, sf_dir, "events").filter("value > 480").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)
    hits = F.reverse(F.array_sort(F.collect_list(F.struct("ts", "event_id"))))
    return top.groupBy("user_id").agg(F.count("*").alias("hits"), F.array_join(F.transform(hits, lambda h: h["event_id"].cast("string")), ",").alias("event_ids"))


@q("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS n FROM documents) WHERE n = 1")
def a30_latest_row(spark, sf_dir):
    return latest(table(spark, sf_dir, "documents"), ["source"], F.desc("doc_id")).select("source", "doc_id", "n_chars")


@q("""SELECT lang, source, doc_id, first_place FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY length(text) DESC, doc_id) AS n,
min(doc_id) OVER (PARTITION BY lang, source) AS first_place FROM documents) WHERE n = 1""")
def a31_longest_per_key(spark, sf_dir):
    return ops.longest_per_key(table(spark, sf_dir, "documents").select("lang", "source", "doc_id", "text"), ["lang", "source"], "text", "doc_id").drop("text")


@q("SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'error' WHEN bool_or(event_type = 'purchase') THEN 'purchase' WHEN bool_or(event_type = 'view') THEN 'view' END AS event_type FROM events GROUP BY 1")
def a32_worst_status(spark, sf_dir):
    return ops.worst_status(table(spark, sf_dir, "events"), "user_id", "event_type", ("error", "purchase", "view"))


_HISTORY = Binding("orders", "o_orderpriority AS sector", "CAST(o_orderdate AS DATE) AS started", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT) AS DATE) END AS ended")


@q(f"""WITH s AS (SELECT *, coalesce(ended <= DATE '1998-06-01', false) AS gone, date_diff('day', started, least(coalesce(ended, DATE '1998-06-01'), DATE '1998-06-01')) AS days FROM ({_HISTORY.sql}) WHERE started <= DATE '1998-06-01')
SELECT sector, count(*) AS entries, count(*) FILTER (gone) AS exits, count(*) FILTER (NOT gone) AS present, count(*) - count(*) FILTER (gone) AS net, avg(days) FILTER (gone) AS mean_stay,
count(*) FILTER (NOT gone AND days > 15) AS long_stays FROM s GROUP BY 1""")
def v08_sector_history(spark, sf_dir):
    return ops.sector_history(_HISTORY.frame(spark, sf_dir), "sector", "started", "ended", F.lit("1998-06-01").cast("date"))


@q("""SELECT day, CASE WHEN p > 5 THEN 'alert' WHEN p > 3 THEN 'warn' ELSE 'ok' END AS quality FROM
(SELECT CAST(ts AS DATE) AS day, max(abs(event_id % 97 - 48)) * 10.0 / count(*) AS p FROM events GROUP BY 1)""")
def t23_residual_quality(spark, sf_dir):
    """The largest residual of a day in percent of what it is measured against."""
    highest = F.max(F.abs(F.col("event_id") % 97 - 48)) * 10.0 / F.count("*")
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(highest.alias("percent"))
    return days.select("day", residual_quality(F.col("percent")).alias("quality"))
