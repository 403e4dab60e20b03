"""W01 to W13 on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import series as ops
from tidewell.plans.registry import Binding, Registry
from tidewell.session import table

q = Registry()
QUERIES, SQL = q.queries, q.sql

_DAYS = "SELECT o_orderstatus AS status, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1, 2"


def _daily(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))


@q(f"""SELECT status, day, n, CASE WHEN row_number() OVER w >= 7 THEN avg(n) OVER (PARTITION BY status ORDER BY day ROWS 6 PRECEDING) END AS sma7
FROM ({_DAYS}) WINDOW w AS (PARTITION BY status ORDER BY day)""")
def w01_moving_average(spark, sf_dir):
    return ops.moving_average(_daily(spark, sf_dir), ["status"], "day", "n", 7, "sma7")


@q(f"""WITH RECURSIVE s AS (SELECT status, day, n, row_number() OVER (PARTITION BY status ORDER BY day) AS i FROM ({_DAYS})),
seed AS (SELECT status, sum(n) / 7.0::DOUBLE AS e FROM s WHERE i <= 7 GROUP BY 1 HAVING count(*) = 7),
r AS (SELECT status, 7::BIGINT AS i, e FROM seed UNION ALL SELECT s.status, s.i, 0.25 * s.n + 0.75 * r.e FROM r JOIN s ON s.status = r.status AND s.i = r.i + 1)
SELECT s.status, s.day, s.n, r.e AS ema7 FROM s LEFT JOIN r ON r.status = s.status AND r.i = s.i""")
def w02_exponential_average(spark, sf_dir):
    return ops.exponential_average(_daily(spark, sf_dir), ["status"], "day", "n", 7, "ema7")


_CALENDAR = "SELECT CAST(d AS DATE) AS day FROM generate_series(DATE '2024-01-01', DATE '2024-02-01', INTERVAL 1 DAY) t(d)"


@q(f"""WITH e AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS mean FROM events WHERE day(ts) % 5 <> 0 GROUP BY 1, 2),
g AS (SELECT event_type, day FROM ({_CALENDAR}), (SELECT DISTINCT event_type FROM events))
SELECT event_type, day, mean, mean - lag(mean) OVER (PARTITION BY event_type ORDER BY day) AS delta FROM g LEFT JOIN e USING (event_type, day)""")
def w03_change_by_day(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kinds = events.select("event_type").distinct().withColumn("day", F.explode(F.expr("sequence(date'2024-01-01', date'2024-02-01')")))
    means = events.filter("day(ts) % 5 <> 0").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("mean"))
    return ops.change_by_day(kinds.join(means, ["event_type", "day"], "left"), ["event_type"], "day", "mean", "delta")


_MOVES = Binding("events", "event_id", "user_id", "CAST(ts AS DATE) AS day", "ts", "event_type AS sector")


@q(f"""SELECT event_id, CASE WHEN n IS NULL AND sector = 'error' THEN 0 ELSE greatest(date_diff('day', day, coalesce(n, DATE '2024-02-05')), 0) END::INTEGER AS stay,
n IS NULL AND sector <> 'error' AS is_active FROM (SELECT *, lead(day) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM ({_MOVES.sql}))""")
def w04_w05_stays(spark, sf_dir):
    today = F.lit("2024-02-05").cast("date")
    return ops.stays(_MOVES.frame(spark, sf_dir), "user_id", "day", ["ts", "event_id"], today, F.col("sector") == "error").select("event_id", "stay", "is_active")


@q(f"SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY day, ts, event_id) - 1)::INTEGER AS sequence FROM ({_MOVES.sql})")
def w06_sequence(spark, sf_dir):
    return ops.numbered(_MOVES.frame(spark, sf_dir), ["user_id"], "day", "ts", "event_id").select("event_id", "sequence")


@q("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
r AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS run FROM d)
SELECT user_id, min(day) AS first, max(day) AS last, count(*) AS days FROM r GROUP BY user_id, run""")
def w07_islands(spark, sf_dir):
    days = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"))
    return ops.islands(days, ["user_id"], "day")


_WORDS = Binding("events", "event_id", "user_id AS page", "value AS x")


@q(f"""WITH RECURSIVE p AS (SELECT page, x, row_number() OVER (PARTITION BY page ORDER BY x) AS i FROM (SELECT DISTINCT page, x FROM ({_WORDS.sql}))),
r AS (SELECT page, x, i, x AS base, 0 AS band FROM p WHERE i = 1 UNION ALL
SELECT p.page, p.x, p.i, CASE WHEN p.x - r.base > 20 THEN p.x ELSE r.base END, r.band + CASE WHEN p.x - r.base > 20 THEN 1 ELSE 0 END FROM r JOIN p ON p.page = r.page AND p.i = r.i + 1)
SELECT event_id, band::INTEGER AS band FROM ({_WORDS.sql}) w JOIN r USING (page, x)""")
def w08_bands(spark, sf_dir):
    return ops.bands(_WORDS.frame(spark, sf_dir), ["page"], "x", 20.0).select("event_id", "band")


@q("""WITH j AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS a, CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 300 AS INTEGER) END AS b FROM orders),
e AS (SELECT o_custkey, a AS moment, 1 AS d FROM j UNION ALL SELECT o_custkey, b, -1 FROM j WHERE b IS NOT NULL)
SELECT o_custkey, max(level)::BIGINT AS peak FROM (SELECT o_custkey, sum(d) OVER (PARTITION BY o_custkey ORDER BY moment, d ROWS UNBOUNDED PRECEDING) AS level FROM e) GROUP BY 1""")
def w09_peak_concurrency(spark, sf_dir):
    spans = Binding("orders", "o_custkey", "CAST(o_orderdate AS DATE) AS a", "CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 300 AS INT) END AS b")
    return ops.peak_concurrency(spans.frame(spark, sf_dir), ["o_custkey"], "a", "b")


@q("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type <> 'view') DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def w11_best_row(spark, sf_dir):
    from tidewell.operators.lookups import latest

    return latest(table(spark, sf_dir, "events"), ["user_id"], F.desc(F.col("event_type") != "view"), F.desc("event_id")).select("user_id", "event_id")


@q("SELECT * FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 7) ORDER BY day")
def w12_last_days(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return days.orderBy(F.desc("day")).limit(7).orderBy("day")


@q("""WITH e AS (SELECT user_id, event_id, ts, value < 200 AS empty FROM events),
r AS (SELECT *, sum((NOT empty)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e),
s AS (SELECT *, CASE WHEN empty THEN sum(empty::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) ELSE 0 END AS empty_streak FROM r),
t AS (SELECT *, coalesce(sum((empty_streak >= 3)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM s)
SELECT event_id, empty_streak::BIGINT AS empty_streak FROM t WHERE reached = 0""")
def w13_empty_streak(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("place", F.struct("ts", "event_id"))
    return ops.until_empty_streak(rows, ["user_id"], "place", F.col("value") < 200, 3).select("event_id", F.col("empty_streak").cast("long").alias("empty_streak"))
