"""V02 to V20 and F01 to F05 on the test tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tidewell.functions.amounts import brl, token_cost
from tidewell.operators import metrics
from tidewell.operators import planning as ops
from tidewell.operators import search
from tidewell.operators.lookups import latest
from tidewell.operators.pages import allowed, day_count, period_days
from tidewell.operators.textindex import TextIndex
from tidewell.plans.lookups import STAYS
from tidewell.plans.registry import Binding, Registry
from tidewell.session import shared_folder, table

q = Registry()
QUERIES, SQL = q.queries, q.sql

_REQUESTS = Binding(
    "orders", "o_orderkey AS request", "CAST(o_orderdate AS DATE) AS admission_date", "CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INT) - 3 AS DATE) AS target_end_date",
    "CASE WHEN o_orderkey % 2 = 0 THEN 'update' ELSE 'generate' END AS mode",
    "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT) AS DATE) END AS prior_coverage_end",
)


def _window_sql(chunk, overlap):
    step = max(1, chunk - overlap)
    return f"""WITH RECURSIVE r AS (SELECT *, CASE WHEN mode = 'update' AND prior_coverage_end IS NOT NULL THEN greatest(admission_date, prior_coverage_end - {overlap - 1}) ELSE admission_date END AS s
FROM ({_REQUESTS.sql}) WHERE NOT (mode = 'update' AND prior_coverage_end IS NOT NULL AND prior_coverage_end >= target_end_date)),
w AS (SELECT request, 0 AS position, s AS window_start, least(s + {chunk - 1}, target_end_date) AS window_end, target_end_date FROM r WHERE s <= target_end_date
UNION ALL SELECT request, position + 1, window_start + {step}, least(window_start + {step + chunk - 1}, target_end_date), target_end_date FROM w WHERE window_end < target_end_date)
SELECT request, position, window_start, window_end FROM w"""


@q(_window_sql(5, 2))
def v02_windows(spark, sf_dir):
    return ops.windows(_REQUESTS.frame(spark, sf_dir), 5, 2)


@q(_window_sql(15, 1))
def v03_chunks(spark, sf_dir):
    return ops.windows(_REQUESTS.frame(spark, sf_dir), 15, 1)


@q("""WITH u AS (SELECT DISTINCT user_id FROM events), d AS (SELECT user_id, CAST(x AS DATE) AS day FROM u, generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY) t(x)),
o AS (SELECT * FROM d EXCEPT SELECT user_id, CAST(ts AS DATE) FROM events), r AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS run FROM o),
g AS (SELECT user_id, min(day) AS a, max(day) AS gap_end FROM r GROUP BY user_id, run)
SELECT user_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY a) = 1 THEN greatest(a - 1, DATE '2024-01-01') ELSE a END AS gap_start, gap_end FROM g""")
def v04_n04_coverage_gaps(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"))
    return ops.coverage_gaps(events, events, "user_id", "2024-01-01", "2024-01-31", overlap_days=1)


_LATEST = f"SELECT * FROM ({STAYS.sql}) QUALIFY row_number() OVER (PARTITION BY patient ORDER BY started DESC NULLS FIRST, admission DESC) = 1"


@q(f"""SELECT s.patient, s.admission, s.started, s.ended, last_event_at FROM ({_LATEST}) s LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last_event_at FROM lineitem GROUP BY 1) ON l_orderkey = admission
WHERE ended IS NULL AND started < TIMESTAMP '2001-07-01' AND (last_event_at IS NULL OR last_event_at < TIMESTAMP '2001-07-01') AND patient IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)""")
def v06_stale_stays(spark, sf_dir):
    events = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("admission"), F.col("l_shipdate").alias("happened_at"))
    present = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("patient"))
    now = F.lit("2001-07-04").cast("timestamp_ntz")
    return ops.stale_stays(STAYS.frame(spark, sf_dir), events, present, now, 72, in_census=True).select("patient", "admission", "started", "ended", "last_event_at")


@q(f"SELECT patient, admission FROM ({_LATEST}) WHERE ended IS NULL AND patient NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def v07_missing_discharges(spark, sf_dir):
    present = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("patient"))
    return ops.missing_discharges(STAYS.frame(spark, sf_dir), present)


@q(f"""SELECT e.event_id, coalesce(c_name, 'user ' || e.user_id) AS name, coalesce(CASE WHEN e.event_id % 3 = 0 THEN (e.event_id % 9)::BIGINT END, date_diff('day', started, DATE '2001-08-02')) AS days
FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) e LEFT JOIN customer ON c_custkey = e.user_id LEFT JOIN ({_LATEST}) ON patient = e.user_id""")
def v09_v10_current_census(spark, sf_dir):
    now = latest(table(spark, sf_dir, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("event_id", "user_id")
    stay = latest(STAYS.frame(spark, sf_dir), ["patient"], F.desc_nulls_first("started"), F.desc("admission"))
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    rows = now.join(names, "user_id", "left").join(stay, F.col("patient") == F.col("user_id"), "left")
    days = F.coalesce(F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 9), F.datediff(F.lit("2001-08-02").cast("date"), "started").cast("long"))
    return rows.select("event_id", F.coalesce("c_name", F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("name"), days.alias("days"))


@q("""SELECT count(*) FILTER (event_type IN ('click', 'view')) AS occupied, count(DISTINCT user_id) AS patients, (SELECT count(*) FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)) AS on_last_day FROM events""")
def v08_v11_tiles(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    last = F.broadcast(events.agg(F.max("day").alias("last")))
    return events.crossJoin(last).agg(F.count_if(F.col("event_type").isin("click", "view")).alias("occupied"), F.count_distinct("user_id").alias("patients"), F.count_if(F.col("day") == F.col("last")).alias("on_last_day"))


_DAYS = "(SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = '{}' GROUP BY 1)"


@q(f"""WITH c AS (SELECT date_trunc('hour', ts) AS captured_at, count(*) FILTER (event_type IN ('click', 'view')) AS present, count(DISTINCT user_id) AS sectors FROM events GROUP BY 1),
a AS {_DAYS.format("signup")}, d AS {_DAYS.format("purchase")}, e AS {_DAYS.format("nobody")}, o AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)
SELECT (SELECT max(captured_at) FROM c) AS captured_at, (SELECT arg_max(present, captured_at) FROM c) AS present, (SELECT arg_max(sectors, captured_at) FROM c) AS sectors, (SELECT count(*) FROM customer) AS patients,
coalesce((SELECT n FROM d WHERE day = DATE '2024-01-15'), 0) AS discharged_today, (SELECT arg_max(n, day) FROM a) AS admissions, (SELECT max(day) FROM a) AS admissions_day, coalesce((SELECT arg_max(n, day) FROM e), 0) AS deaths,
coalesce((SELECT max(day) FROM e), DATE '2024-01-15') AS deaths_day, (SELECT arg_max(n, day) FROM d) AS discharges, (SELECT max(day) FROM d) AS discharges_day, (SELECT arg_max(n, day) FROM o) AS official, (SELECT max(day) FROM o) AS official_day""")
def v11_dashboard(spark, sf_dir):
    """Signups as admissions, purchases as discharges, nothing as deaths, orders as the official list."""
    events = table(spark, sf_dir, "events")
    snapshots = events.select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("captured_at"), F.col("user_id").alias("sector"), F.when(F.col("event_type").isin("click", "view"), "occupied").otherwise("empty").alias("status"))
    days = lambda kind: events.filter(F.col("event_type") == kind).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    official = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))
    return metrics.dashboard(snapshots, table(spark, sf_dir, "customer"), days("signup"), days("purchase"), days("nobody"), official, F.lit("2024-01-15").cast("date"))


_PERIODS = (("24h", 1), ("7d", 7), ("30d", 30), ("a year", 1))
_CHOICES = (("30", 30), ("90", 90), ("8", 7), ("", 7))
_COUNTS = (("5", 5), ("0", 90), ("4000", 4000), ("x", 90))


@q(" UNION ALL ".join(f"SELECT '{kind}' AS parameter, '{given}' AS given, {days}::BIGINT AS days, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL {days} DAY"
   for kind, values in (("period", _PERIODS), ("allowed", _CHOICES), ("days", _COUNTS)) for given, days in values))
def p04_p05_p06_parameters(spark, sf_dir):
    """Events of the last days, as many as a user's parameter means."""
    meant = [("period", g, period_days(g)) for g, _ in _PERIODS] + [("allowed", g, allowed(g, (7, 30, 90), 7)) for g, _ in _CHOICES] + [("days", g, day_count(g)) for g, _ in _COUNTS]
    wanted = F.broadcast(spark.createDataFrame(meant, "parameter string, given string, days long"))  # a dozen rows
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    last = F.broadcast(events.agg(F.max("ts").alias("last")))
    age = (F.unix_micros("last") - F.unix_micros("ts")) / 86_400_000_000
    return events.crossJoin(last).select(age.alias("age")).join(wanted, F.col("age") < F.col("days")).groupBy("parameter", "given", "days").agg(F.count("*").alias("n"))


_RUNS = Binding(
    "orders", "o_orderkey AS run", "o_custkey AS batch", "CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE 'queued' END END AS status",
    "CASE o_orderkey % 4 WHEN 0 THEN 'full_sync' WHEN 1 THEN 'census_extraction' WHEN 2 THEN 'admissions_only' ELSE 'other' END AS intent", "CAST(o_orderdate AS DATE) AS started",
    "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 500 AS INT) AS DATE) END AS heartbeat", "CAST(o_orderdate AS DATE) AS queued_at",
    "CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END AS finished",
)


_BATCHES = Binding("customer", "c_custkey AS batch", "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST('2001-07-01' AS DATE) END AS finished")


@q(f"""WITH r AS (SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'running' AND started < DATE '2001-05-02') AS stale,
max(started) FILTER (status = 'succeeded' AND intent = 'census_extraction') AS census, max(finished) FILTER (status = 'failed') AS failed FROM (SELECT * REPLACE (CASE WHEN status IN ('failed', 'succeeded') THEN started END AS finished) FROM ({_RUNS.sql}))),
b AS (SELECT count(*) FILTER (finished IS NULL) AS open_batches FROM ({_BATCHES.sql})), l AS (SELECT *, 400 * 1440.0 - date_diff('day', census, DATE '2001-08-02') * 1440.0 AS cooldown,
CASE WHEN census IS NULL OR failed > census THEN 500 * 1440.0 - date_diff('day', failed, DATE '2001-08-02') * 1440.0 END AS backoff FROM r, b),
o AS (SELECT queued, running, stale, open_batches, CASE WHEN cooldown > 0 THEN cooldown END AS cooldown_left, CASE WHEN backoff > 0 THEN backoff END AS backoff_left FROM l)
SELECT *, queued = 0 AND running = 0 AND stale = 0 AND open_batches = 0 AND cooldown_left IS NULL AND backoff_left IS NULL AS eligible FROM o""")
def v12_eligibility(spark, sf_dir):
    runs = _RUNS.frame(spark, sf_dir).withColumn("finished", F.when(F.col("status").isin("failed", "succeeded"), F.col("started")))
    return ops.eligibility(runs, _BATCHES.frame(spark, sf_dir), F.lit("2001-08-02").cast("timestamp_ntz"), 400 * 24 * 60, 92 * 24 * 60, 500 * 24 * 60)


_OFFICIAL = Binding("events", "event_id AS id", "CAST(ts AS DATE) AS day", "CAST(user_id % 9 AS STRING) AS unidade", "props AS quarto_leito", "event_type AS especialidade", "CASE WHEN event_id % 6 = 0 THEN '' ELSE concat(CAST(event_id % 50 AS STRING), ' dias') END AS tempo_internacao")


@q(f"""WITH r AS (SELECT *, coalesce(try_cast(nullif(regexp_replace(tempo_internacao, '\\D', '', 'g'), '') AS INT), 0) AS n FROM ({_OFFICIAL.sql}) WHERE especialidade = 'view'),
m AS (SELECT * FROM r WHERE day = (SELECT max(CAST(ts AS DATE)) FROM events)), w AS (SELECT n_nationkey::VARCHAR AS unidade, n_name FROM nation WHERE n_nationkey < 6)
SELECT id, coalesce(n_name, unidade) AS ward, tempo_internacao, row_number() OVER (ORDER BY n DESC, id) - 1 AS place FROM m LEFT JOIN w USING (unidade)""")
def v10_official_census(spark, sf_dir):
    wards = table(spark, sf_dir, "nation").filter("n_nationkey < 6").select(F.col("n_nationkey").cast("string").alias("unidade"), F.col("n_name").alias("ward"))
    return ops.official_census(_OFFICIAL.frame(spark, sf_dir), wards, day="not a day", specialty="view", order="tempo_desc").select("id", "ward", "tempo_internacao", "place")


@q(f"""WITH w AS (SELECT n_nationkey::VARCHAR AS unidade, n_name FROM nation) SELECT id, coalesce(n_name, unidade) AS ward, tempo_internacao, row_number() OVER (ORDER BY unidade, quarto_leito, id) - 1 AS place
FROM ({_OFFICIAL.sql}) LEFT JOIN w USING (unidade) WHERE day = DATE '2024-01-10'""")
def v10_official_census_by_unit(spark, sf_dir):
    wards = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("unidade"), F.col("n_name").alias("ward"))
    return ops.official_census(_OFFICIAL.frame(spark, sf_dir), wards, day="2024-01-10", order="unidade").select("id", "ward", "tempo_internacao", "place")


@q(f"""SELECT run FROM ({_RUNS.sql}) WHERE status = 'running' AND started < DATE '2000-01-01' AND (heartbeat IS NULL OR heartbeat < DATE '2000-01-01')""")
def v13_stale_runs(spark, sf_dir):
    return ops.stale_runs(_RUNS.frame(spark, sf_dir), F.lit("2000-01-01").cast("timestamp_ntz")).select("run")


@q(f"""SELECT batch, CASE WHEN bool_or(status IN ('queued', 'running')) THEN 'open' WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'succeeded' END AS state FROM ({_RUNS.sql}) GROUP BY 1""")
def v14_closed_batches(spark, sf_dir):
    return ops.closed_batches(_RUNS.frame(spark, sf_dir))


@q("""WITH a AS (SELECT CAST(ts AS DATE) AS day, CASE event_type WHEN 'click' THEN 'deaths' WHEN 'view' THEN 'admissions' END AS extractor, arg_max(props, event_id) AS outcome FROM events GROUP BY 1, 2)
SELECT CAST(d AS DATE) AS day, e AS extractor, coalesce(outcome, 'planned') AS outcome FROM generate_series(DATE '2024-01-01', DATE '2024-01-20', INTERVAL 1 DAY) t(d), (VALUES ('deaths'), ('admissions'), ('discharges')) v(e)
LEFT JOIN a ON a.day = CAST(d AS DATE) AND a.extractor = e""")
def v15_recovery_plan(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "deaths").when(F.col("event_type") == "view", "admissions")
    attempts = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), kind.alias("extractor"), F.col("props").alias("outcome"), F.col("event_id").alias("round"))
    return ops.recovery_plan(spark, "2024-01-01", "2024-01-20", ["deaths", "admissions", "discharges"], attempts)


@q(f"""SELECT admission, CASE WHEN c IS NULL THEN 'none' WHEN c < least(DATE '2001-08-02', coalesce(ended, DATE '2001-08-02')) THEN 'outdated' ELSE 'current' END AS badge
FROM ({STAYS.sql}) LEFT JOIN (SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) AS c FROM lineitem WHERE l_orderkey % 3 > 0 GROUP BY 1) ON l_orderkey = admission""")
def v16_summary_state(spark, sf_dir):
    states = table(spark, sf_dir, "lineitem").filter("l_orderkey % 3 > 0").groupBy(F.col("l_orderkey").alias("admission")).agg(F.max(F.to_date("l_shipdate")).alias("coverage_end"))
    return ops.summary_state(states, STAYS.frame(spark, sf_dir), F.lit("2001-08-02").cast("date"))


@q("SELECT event_id FROM events WHERE ts >= DATE '2024-01-05' AND ts < DATE '2024-01-11' AND ts <= TIMESTAMP '2024-01-10 12:00:00'")
def v17_pinned_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("happened_at", F.col("ts"))
    day = lambda d: F.lit(d).cast("date")
    return ops.pinned_events(events, day("2024-01-05"), day("2024-01-10"), F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")).select("event_id")


@q("""SELECT o_orderkey, cost, 'R$ ' || translate(format('{:,.2f}', round(cost * 5, 2)::DECIMAL(18,2)), ',.', '.,') AS price FROM
(SELECT o_orderkey, (o_orderkey % 50000 * 0.005 / 1000 + o_custkey * 0.015 / 1000)::DECIMAL(18,6) AS cost FROM orders)""")
def v18_cost_log(spark, sf_dir):
    rates = spark.sql("SELECT * FROM VALUES (date'2024-01-01', 4.0), (date'2024-01-09', 5.0) AS r(reference, rate)")
    rate = F.broadcast(rates.agg(F.max_by("rate", "reference").alias("rate")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", token_cost(F.col("o_orderkey") % 50000, F.col("o_custkey")).alias("cost")).crossJoin(rate)
    return rows.select("o_orderkey", "cost", brl(F.round(F.col("cost") * F.col("rate"), 2)).alias("price"))


@q("SELECT c_custkey, nullif(ltrim(regexp_replace(c_name, '[^0-9]', '', 'g'), '0'), '') IS NOT DISTINCT FROM (c_custkey - c_custkey % 2)::VARCHAR AND c_custkey > 1 AS same FROM customer")
def v19_same_identity(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", (F.col("c_custkey") - F.col("c_custkey") % 2).cast("string").alias("wanted"))
    return ops.same_identity(rows, "wanted", "c_name").select("c_custkey", "same")


@q(f"SELECT request, mode = 'update' AND coalesce(prior_coverage_end >= target_end_date, false) AS reuse FROM ({_REQUESTS.sql})")
def v20_reusable(spark, sf_dir):
    return ops.reusable(_REQUESTS.frame(spark, sf_dir).withColumnRenamed("prior_coverage_end", "coverage_end")).select("request", "reuse")


@q("""SELECT doc_id, CASE WHEN upper(text) = 'THE' THEN 3 WHEN contains(upper(text), ' THE ') THEN 2 ELSE 1 END AS relevance, substr(text, 1, 300) AS short FROM documents WHERE contains(upper(text), 'THE')
ORDER BY relevance DESC, n_chars DESC, doc_id DESC LIMIT 50""")
def f03_s16_substring_search(spark, sf_dir):
    found = search.substring_search(table(spark, sf_dir, "documents"), "text", "the", "n_chars", "doc_id")
    return found.select("doc_id", "relevance", F.substring("text", 1, 300).alias("short"))


@q("SELECT doc_id FROM documents WHERE false")
def f04_blank_query(spark, sf_dir):
    return search.substring_search(table(spark, sf_dir, "documents"), "text", "  ", "n_chars", "doc_id").select("doc_id")


#: The tokens of every word of every document, by the rules of ``search.tokens``.
_TOKENS = rf"""t AS (SELECT doc_id, unnest(regexp_split_to_array(translate(lower(coalesce(text, '')), '{search.ACCENTS[0]}', '{search.ACCENTS[1]}'), '[^a-z0-9]+')) AS w FROM documents),
k AS (SELECT doc_id, CASE WHEN length(w) >= 5 THEN regexp_replace(regexp_replace(w, 's$', ''), '({"|".join(search.ENDINGS)})$', '') ELSE w END AS token
      FROM t WHERE w <> '' AND w NOT IN ({", ".join(f"'{w}'" for w in search.STOP_WORDS)})),
l AS (SELECT doc_id, count(*) AS length FROM k GROUP BY 1),
n AS (SELECT doc_id, token, count(*) AS n FROM k GROUP BY 1, 2)"""


def document_index(spark, sf_dir):
    """The stored index of ``documents``, with all files that the table has now."""
    folder = f"{shared_folder(spark)}/tidewell/index-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    index = TextIndex(spark, folder, "doc_id", "long", "text")
    index.refresh(table(spark, sf_dir, "documents"))
    return index


@q(f"""WITH {_TOKENS} SELECT doc_id, sum(1 + ln(n)) / (1 + ln(max(length))) AS score FROM n JOIN l USING (doc_id) WHERE token IN ('los', 'idiot') GROUP BY 1 HAVING count(*) = 2""")
def f01_f02_token_search(spark, sf_dir):
    return document_index(spark, sf_dir).search("the idiots, losers")


@q(f"""WITH {_TOKENS}, f AS (SELECT token, count(*) AS documents FROM n GROUP BY 1), top AS (SELECT token FROM f ORDER BY documents DESC, token LIMIT 3)
SELECT doc_id, sum(1 + ln(n)) / (1 + ln(max(length))) AS score FROM n JOIN l USING (doc_id) JOIN top USING (token) GROUP BY 1 HAVING count(*) = 3""")
def f02_frequent_tokens(spark, sf_dir):
    """The documents with all of the three tokens that most documents have: long lists of postings, read by ranges."""
    index = document_index(spark, sf_dir)
    return index.search_tokens([r["token"] for r in index.frequent(3)])


@q("""SELECT source, count(*) AS documents, sum((contains(upper(text), 'IDIOT'))::INT + (contains(upper(text), 'CLOWN'))::INT)::BIGINT AS hits FROM documents
WHERE contains(upper(text), 'IDIOT') OR contains(upper(text), 'CLOWN') GROUP BY 1""")
def f05_any_term(spark, sf_dir):
    found = search.any_term(table(spark, sf_dir, "documents"), "text", "idiot, clown,")
    return found.groupBy("source").agg(F.count("*").alias("documents"), F.sum("hits").alias("hits"))
