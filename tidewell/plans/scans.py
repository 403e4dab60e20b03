"""S10 to S25, Z01 to Z07 on the test tables, as far as they hold what these read; files are in the tests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewell.operators import ledger
from tidewell.plans.registry import Binding, Registry
from tidewell.session import shared_folder, table
from tidewell.sources import files, partitions
from tidewell.streaming import snapshots, stateful

q = Registry()
QUERIES, SQL = q.queries, q.sql


@q(r"""WITH a AS (SELECT page_id, regexp_extract_all(html, '(?s)<li[^>]*>.*?</li>') AS rows FROM pages),
r AS (SELECT page_id, unnest(rows) AS r, generate_subscripts(rows, 1) - 1 AS position FROM a)
SELECT page_id, position::INTEGER AS position, CASE WHEN regexp_extract(r, 'href="/([^",]+)"', 1) <> '' THEN regexp_extract(r, 'href="/([^",]+)"', 1) ELSE 'row-' || position END AS row_key,
array_to_string(list_transform(regexp_extract_all(r, '(?s)<a[^>]*>(.*?)</a>', 1), lambda c: trim(regexp_replace(c, '<[^>]+>', '', 'g'))), '|') AS cells FROM r""")
def s21_table_rows(spark, sf_dir):
    rows = files.table_rows(table(spark, sf_dir, "pages"), "page_id", F.col("html"), "(?s)<li[^>]*>.*?</li>", "(?s)<a[^>]*>(.*?)</a>", 'href="/([^",]+)"')
    return rows.withColumn("cells", F.array_join("cells", "|"))


_EMBEDDED = Binding(
    "events", "event_id",
    "CASE WHEN event_id % 3 = 0 THEN concat('<p><script type=\"application/json\">', props, '</script>') WHEN event_id % 3 = 1 THEN concat('<pre class=\"x\">', event_type, '</pre>') ELSE '<p>' END AS html",
    "CASE WHEN event_id % 4 = 0 THEN concat('[{\"admissionKey\": \"', CAST(event_id AS STRING), '\", \"admissionStart\": \"2024\"}, {\"admissionKey\": \"\"}]') ELSE '[]' END AS items",
    "CASE WHEN event_id % 2 = 0 THEN concat('{\"happenedAt\": \"', CAST(user_id AS STRING), '\", \"content_text\": \"c\"}') ELSE '{\"happened_at\": \"x\", \"happenedAt\": \"\", \"authorName\": \"a\"}' END AS item",
)


@q(f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 3 = 1 THEN event_type END AS pre FROM events""")
def s22_embedded_json(spark, sf_dir):
    rows = _EMBEDDED.frame(spark, sf_dir)
    return rows.select("event_id", files.embedded_json(F.col("html"), "k string")["k"].alias("k"), files.preformatted(F.col("html")).alias("pre"))


@q("SELECT event_id, event_id::VARCHAR AS admission FROM events WHERE event_id % 4 = 0")
def s10_snapshot_items(spark, sf_dir):
    items = files.snapshot_items(_EMBEDDED.frame(spark, sf_dir).select("event_id", "items"), "items")
    return items.select("event_id", F.col("item")["admissionKey"].alias("admission"))


@q("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id::VARCHAR ELSE 'x' END AS happened_at, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'a' END AS author, CASE WHEN event_id % 2 = 0 THEN 'c' ELSE '' END AS content FROM events""")
def s11_s25_event_items(spark, sf_dir):
    item = files.event_item(F.from_json("item", "map<string,string>"))
    return _EMBEDDED.frame(spark, sf_dir).select("event_id", item.alias("i")).select("event_id", "i.happened_at", "i.author", "i.content")


@q("""SELECT doc_id, source, substr(text, 1, 300) AS text FROM documents""")
def s16_json_results(spark, sf_dir):
    """Whole documents as JSON with their texts cut, read back from the JSON."""
    found = files.search_results(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text", 300)
    return found.select(F.from_json("json", "doc_id long, source string, text string").alias("j")).select("j.*")


@q("SELECT user_id, event_id, event_type FROM events")
def s18_flattened(spark, sf_dir):
    nested = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.struct("event_id", "event_type")).alias("patients"))
    return files.flattened(nested, "user_id", "patients")


def _events_as_files(spark, sf_dir):
    """A stream of the events table, laid out as three files."""
    folder = f"{shared_folder(spark)}/tidewell/stream-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    rows.repartition(3, "user_id").write.parquet(f"{folder}/in")
    return folder, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


@q("SELECT event_id FROM events WHERE date_trunc('hour', ts) = (SELECT max(date_trunc('hour', ts)) FROM events)")
def z01_latest_snapshot_stream(spark, sf_dir):
    folder, stream = _events_as_files(spark, sf_dir)
    snapshots.latest_snapshot(stream.withColumn("hour", F.date_trunc("hour", "ts")), f"{folder}/out", f"{folder}/state", "hour").awaitTermination()
    return snapshots.newest_rows(spark, f"{folder}/out").select("event_id")


@q("SELECT user_id || '|' || CAST(ts AS DATE) AS identity, event_type AS content, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def z05_ledger_stream(spark, sf_dir):
    folder, stream = _events_as_files(spark, sf_dir)
    keyed = stream.select("event_id", F.concat_ws("|", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("identity"), F.col("event_type").alias("content"))
    snapshots.ledger_stream(keyed, f"{folder}/out", f"{folder}/state", "event_id").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("identity", "content", "event_id")


#: The file that an event comes in: a quarter of the time that the events span, and one or more later for events that come late.
_ARRIVAL = """s AS (SELECT min(ts) AS low, epoch_us(max(ts)) - epoch_us(min(ts)) AS span FROM events),
e AS (SELECT events.*, least(3, 4 * (epoch_us(ts) - epoch_us(low)) // (span + 1)) AS slice FROM events, s)"""


def _events_in_order(spark, sf_dir, arrives):
    """A stream of the events table in files that come one after the other, each of the events that ``arrives`` gives its number."""
    folder = f"{shared_folder(spark)}/tidewell/stream-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value").withColumn("us", F.unix_micros("ts"))
    span = F.broadcast(rows.agg(F.min("us").alias("low"), (F.max("us") - F.min("us")).alias("span")))
    rows = rows.crossJoin(span).withColumn("slice", F.expr("least(3, (4 * (us - low)) DIV (span + 1))")).drop("us", "low", "span")
    rows = rows.withColumn("file", F.explode(arrives))
    parts = sorted(r[0] for r in rows.select("file").distinct().collect())  # a few numbers
    for k in parts:
        rows.filter(F.col("file") == k).drop("slice", "file").repartition(1).write.mode("append").parquet(f"{folder}/in")
    return folder, spark.readStream.schema(rows.drop("slice", "file").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


@q(f"""WITH {_ARRIVAL}, a AS (SELECT *, CASE WHEN event_id % 50 = 0 THEN 4 WHEN event_id % 11 = 0 THEN slice + 1 ELSE slice END AS file FROM e),
m AS (SELECT file, max(ts) AS newest FROM a GROUP BY 1), w AS (SELECT k.file, max(m.newest) - INTERVAL 2 DAY AS mark FROM m k JOIN m ON m.file < k.file - 1 GROUP BY 1)
SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM a LEFT JOIN w USING (file) WHERE mark IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > mark GROUP BY 1, 2""")
def z04_z06_z07_window_counts(spark, sf_dir):
    """Daily counts of a stream in which one event in eleven comes a file late and one in fifty at the very end: what lies two days behind the watermark counts no more."""
    late = F.when(F.col("event_id") % 50 == 0, 4).when(F.col("event_id") % 11 == 0, F.col("slice") + 1).otherwise(F.col("slice"))
    folder, stream = _events_in_order(spark, sf_dir, F.array(late.cast("int")))
    counted = snapshots.counts_by_window(stream, "ts", "event_type", "1 day", "2 days").select("event_type", F.col("window.start").alias("day"), "n")

    def keep(batch, epoch):  # each batch has the newest counts of the windows that it changed
        batch.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    counted.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    newest = spark.read.schema("event_type string, day timestamp, n long, epoch int").parquet(f"{folder}/out").groupBy("event_type", "day").agg(F.max_by("n", "epoch").alias("n"))
    return newest.withColumn("day", F.col("day").cast("timestamp_ntz"))


@q("SELECT event_id FROM events")
def z04_first_events(spark, sf_dir):
    """Every event arrives twice, the second time in the next file; each counts once, and the state holds two days."""
    folder, stream = _events_in_order(spark, sf_dir, F.array(F.col("slice"), F.col("slice") + 1))
    once = snapshots.first_events(stream, "ts", ["event_id"], "2 days").select("event_id")
    once.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(once.schema).parquet(f"{folder}/out")


@q(f"""WITH {_ARRIVAL}, a AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, CASE WHEN slice = 0 THEN 0 WHEN event_id % 7 = 0 THEN least(3, slice + 1) ELSE slice END AS file FROM e),
c AS (SELECT DISTINCT k.user_id, k.file, max(p.day) AS through FROM (SELECT DISTINCT user_id, file FROM a) k LEFT JOIN a p ON p.user_id = k.user_id AND p.file < k.file GROUP BY ALL)
SELECT user_id AS who, event_id AS id, day, CASE WHEN day <= through - 1 THEN 'late' WHEN day <= through THEN 'again' ELSE 'new' END AS kind FROM a JOIN c USING (user_id, file) WHERE file > 0""")
def z04_late_events(spark, sf_dir):
    """The first quarter is covered; the rest comes in three files, one event in seven a file late."""
    first = F.col("slice") == 0
    file = F.when(first, 0).when(F.col("event_id") % 7 == 0, F.least(F.lit(3), F.col("slice") + 1)).otherwise(F.col("slice"))
    folder, stream = _events_in_order(spark, sf_dir, F.filter(F.array(file.cast("int")), lambda k: k > 0))
    rows = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.to_date("ts").alias("day"))
    span = F.broadcast(rows.agg(F.min("us").alias("low"), (F.max("us") - F.min("us")).alias("span")))
    covered = rows.crossJoin(span).filter("(4 * (us - low)) DIV (span + 1) = 0").groupBy(F.col("user_id").alias("who")).agg(F.max(F.unix_date("day")).alias("through"))
    named = stream.select(F.col("user_id").alias("who"), F.col("event_id").alias("id"), F.unix_date(F.to_date("ts")).alias("day"))
    judged = stateful.against_coverage(named, covered, 1)
    judged.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(judged.schema).parquet(f"{folder}/out").withColumn("day", F.date_from_unix_date("day"))


#: Seconds after which a run of an intent is too old, and after which a beat is.
_LIMITS, _LIMIT, _GRACE = {"purchase": 6 * 3600, "error": 3600}, 3 * 3600, 2 * 3600


@q(f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, {1_000_000}::BIGINT * CASE event_type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in _LIMITS.items())} ELSE {_LIMIT} END AS age,
row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, k, t AS began, t AS last, age, 1 AS beats FROM e WHERE k = 1
UNION ALL SELECT r.user_id, e.k, CASE WHEN e.t > greatest(began + r.age, last + {_GRACE * 1_000_000}::BIGINT) THEN e.t ELSE began END, e.t,
CASE WHEN e.t > greatest(began + r.age, last + {_GRACE * 1_000_000}::BIGINT) THEN e.age ELSE r.age END, CASE WHEN e.t > greatest(began + r.age, last + {_GRACE * 1_000_000}::BIGINT) THEN 1 ELSE beats + 1 END
FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1),
d AS (SELECT user_id, began, max(last) AS last, max(beats) AS beats, max(age) AS age FROM r GROUP BY 1, 2)
SELECT user_id AS job, make_timestamp(began) AS began, make_timestamp(last) AS last_beat, beats::BIGINT AS beats, make_timestamp(greatest(began + age, last + {_GRACE * 1_000_000}::BIGINT)) AS silent_at
FROM d WHERE greatest(began + age, last + {_GRACE * 1_000_000}::BIGINT) < (SELECT max(epoch_us(ts)) - 1000 FROM events)""")
def z06_silent_jobs(spark, sf_dir):
    """Users as jobs, events as their beats, in four files: the runs that timers found silent, those of users without another event too."""
    folder, stream = _events_in_order(spark, sf_dir, F.array(F.col("slice")))
    beats = stream.select(F.col("user_id").alias("job"), F.col("ts").alias("at"), F.col("event_type").alias("intent"))
    found = stateful.silent_runs(beats, _LIMITS, _LIMIT, _GRACE)
    found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(found.schema).parquet(f"{folder}/out")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("began", "last_beat", "silent_at")})


@q("SELECT event_id, user_id, value FROM events")
def s17_bulk_insert(spark, sf_dir):
    folder, stream = _events_in_order(spark, sf_dir, F.array(F.col("slice")))
    partitions.inserting(stream.select("event_id", "user_id", "value"), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")


@q("SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS people, max(value) AS most FROM events GROUP BY 1")
def u11_u16_day_counts(spark, sf_dir):
    """Each batch is inserted under its number; then the counts of the days that it touched, and of no others, are made again from all batches."""
    late = F.when(F.col("event_id") % 11 == 0, F.col("slice") + 1).otherwise(F.col("slice"))
    folder, stream = _events_in_order(spark, sf_dir, F.array(late.cast("int")))
    facts = stream.select("event_id", "user_id", "value", F.to_date("ts").alias("day"))
    summary = lambda rows: rows.groupBy("day").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("people"), F.max("value").alias("most"))
    rebuild = lambda batch, _: partitions.rebuild_parts(spark, spark.read.parquet(f"{folder}/facts"), batch, "day", summary, f"{folder}/days")
    partitions.inserting(facts, f"{folder}/facts", f"{folder}/state", rebuild).awaitTermination()
    return spark.read.parquet(f"{folder}/days").select("day", "n", "people", "most")


@q("""WITH e AS (SELECT event_id, CAST(ts AS DATE) AS day, value FROM events), i AS (SELECT event_id, day, value * 2 AS value FROM e WHERE day(day) % 3 = 0 AND event_id % 2 = 0)
SELECT * FROM e WHERE day NOT IN (SELECT day FROM i) UNION ALL SELECT * FROM i""")
def u06_u20_replaced_parts(spark, sf_dir):
    """A table by day, of which some days come again and are replaced where they lie."""
    folder = f"{shared_folder(spark)}/tidewell/parts-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"), "value")
    partitions.replace_parts(rows, folder, "day")
    partitions.replace_parts(rows.filter("day(day) % 3 = 0 AND event_id % 2 = 0").withColumn("value", F.col("value") * 2), folder, "day")
    return spark.read.parquet(folder).select("event_id", "day", "value")


@q("SELECT CAST(ts AS DATE) AS day, count(*) AS n, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def u11_z07_rebuilt_days(spark, sf_dir):
    """Rows that come late belong to the day they were captured on: the summaries of those days, and of no others, are made again."""
    rows = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    summary = lambda r: r.groupBy("day").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    late = rows.filter("event_id % 50 = 0 AND day(day) % 4 = 0")
    stored = summary(rows.filter("NOT (event_id % 50 = 0 AND day(day) % 4 = 0)"))
    return ledger.replaced(stored, summary(rows.join(snapshots.touched_days(late, "ts"), "day", "left_semi")), "day")
