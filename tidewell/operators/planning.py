"""Windows to extract, gaps of coverage, and states of jobs and summaries. Today and now are arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.strings import number_in
from tidewell.operators.lookups import with_name
from tidewell.operators.places import placed


def windows(requests: DataFrame, chunk_days: int, overlap_days: int) -> DataFrame:
    """Requests (request, admission_date, target_end_date, mode, prior_coverage_end) with position, window_start, window_end.

    Windows of ``chunk_days`` go forward by chunk less overlap, a day at least, until one reaches the target. An update begins
    ``overlap_days`` before the end of what is covered, not before the admission; it has no window when all is covered.
    """
    step = max(1, chunk_days - overlap_days)
    target, prior = F.col("target_end_date"), F.col("prior_coverage_end")
    update = (F.col("mode") == "update") & prior.isNotNull()
    start = F.when(update, F.greatest(F.col("admission_date"), F.date_add(prior, 1 - overlap_days))).otherwise(F.col("admission_date"))
    due = requests.withColumn("_start", start).filter((F.col("_start") <= target) & ~F.coalesce(update & (prior >= target), F.lit(False)))
    # The last window is the first whose end reaches the target.
    more = F.ceil(F.greatest(F.datediff(target, F.col("_start")) + 1 - chunk_days, F.lit(0)) / step).cast("int")
    out = due.select("request", "target_end_date", "_start", F.explode(F.sequence(F.lit(0), more)).alias("position"))
    begin = F.date_add(F.col("_start"), F.col("position") * step)
    return out.select("request", "position", begin.alias("window_start"), F.least(F.date_add(begin, chunk_days - 1), target).alias("window_end"))


def coverage_gaps(entities: DataFrame, covered: DataFrame, key: str, first: str, last: str, overlap_days: int = 0) -> DataFrame:
    """key, gap_start, gap_end: runs of days of [first, last] without a row in ``covered`` (key, day).

    The first gap of a key begins ``overlap_days`` earlier, for what was registered late, but not before ``first``.
    """
    inside = covered.select(key, F.col("day").cast("date").alias("day")).filter(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    edges = entities.select(key).distinct().select(key, F.explode(F.array(F.date_sub(F.lit(first).cast("date"), 1), F.date_add(F.lit(last).cast("date"), 1))).alias("day"))
    inside = inside.distinct().join(entities.select(key).distinct(), key, "left_semi")
    w = Window.partitionBy(key).orderBy("day")
    gaps = inside.unionByName(edges).withColumn("_before", F.lag("day").over(w)).filter(F.datediff("day", "_before") > 1)
    gaps = gaps.select(key, F.date_add("_before", 1).alias("gap_start"), F.date_sub("day", 1).alias("gap_end"))
    earlier = F.greatest(F.date_sub("gap_start", overlap_days), F.lit(first).cast("date"))
    is_first = F.row_number().over(Window.partitionBy(key).orderBy("gap_start")) == 1
    return gaps.withColumn("gap_start", F.when(is_first, earlier).otherwise(F.col("gap_start")))


def stale_stays(stays: DataFrame, events: DataFrame, present: DataFrame, now: Column, hours: int, in_census: bool | None = None) -> DataFrame:
    """Open stays older than ``hours`` that are their patient's latest and have no event in that time; filtered by presence in the census.

    The latest stay is the one that began last, one without a begin first of all; then the largest number.
    """
    limit = now - F.expr(f"interval {hours} hours")
    w = Window.partitionBy("patient").orderBy(F.desc_nulls_first("started"), F.desc("admission"))
    latest = stays.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1 AND ended IS NULL").drop("_nth").filter(F.col("started") < limit)
    last_event = events.groupBy("admission").agg(F.max("happened_at").alias("last_event_at"))
    out = latest.join(last_event, "admission", "left").filter(F.col("last_event_at").isNull() | (F.col("last_event_at") < limit))
    if in_census is None:
        return out
    return out.join(present.select("patient").distinct(), "patient", "left_semi" if in_census else "left_anti")


def missing_discharges(stays: DataFrame, present: DataFrame) -> DataFrame:
    """patient, admission: patients with an open stay whose latest one is open and who are not in the census; their latest open stay."""
    w = Window.partitionBy("patient").orderBy(F.desc_nulls_first("started"), F.desc("admission"))
    latest = stays.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1 AND ended IS NULL")
    return latest.join(present.select("patient").distinct(), "patient", "left_anti").select("patient", "admission")


def eligibility(runs: DataFrame, batches: DataFrame, now: Column, cooldown_minutes: int, stale_minutes: int, backoff_minutes: int) -> DataFrame:
    """One row: queued, running, stale, open_batches, cooldown_left and backoff_left in minutes (null where there is none), and whether a new cycle may begin.

    A cycle begins when nothing is queued, running or stale, no batch (finished) is open, the last census that succeeded began
    ``cooldown_minutes`` ago and the last run that failed after it finished ``backoff_minutes`` ago.
    """
    minutes = lambda a: (F.unix_micros(now.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 6e7
    begun = F.coalesce("started", "queued_at")
    census = (F.col("status") == "succeeded") & (F.col("intent") == "census_extraction")
    out = runs.agg(
        F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(F.col("status") == "running").alias("running"),
        F.count_if((F.col("status") == "running") & (minutes(begun) > stale_minutes)).alias("stale"),
        F.max(F.when(census, F.col("started"))).alias("_census"), F.max(F.when(F.col("status") == "failed", F.col("finished"))).alias("_failed"),
    )
    out = out.crossJoin(batches.agg(F.count_if(F.col("finished").isNull()).alias("open_batches")))  # one row each
    cooldown = cooldown_minutes - minutes(F.col("_census"))
    backoff = F.when(F.col("_census").isNull() | (F.col("_failed") > F.col("_census")), backoff_minutes - minutes(F.col("_failed")))
    out = out.withColumns({"cooldown_left": F.when(cooldown > 0, cooldown), "backoff_left": F.when(backoff > 0, backoff)}).drop("_census", "_failed")
    idle = (F.col("queued") == 0) & (F.col("running") == 0) & (F.col("stale") == 0) & (F.col("open_batches") == 0)
    return out.withColumn("eligible", idle & F.col("cooldown_left").isNull() & F.col("backoff_left").isNull())


#: Minutes after which a running job counts as stale, by intent, and for any other.
STALE_MINUTES = {"admissions_only": 20, "demographics_only": 20, "full_sync": 60, "census_extraction": 120}
OTHER_STALE_MINUTES, GRACE_MINUTES = 60, 10


def stale_runs(runs: DataFrame, now: Column) -> DataFrame:
    """Running ones older than their intent's limit whose heartbeat is missing or older than the grace."""
    limits = F.create_map(*[F.lit(x) for kv in STALE_MINUTES.items() for x in kv])
    minutes = lambda a: (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(a).cast("timestamp"))) / 6e7
    silent = F.col("heartbeat").isNull() | (minutes("heartbeat") > GRACE_MINUTES)
    return runs.filter((F.col("status") == "running") & (minutes("started") > F.coalesce(limits[F.col("intent")], F.lit(OTHER_STALE_MINUTES))) & silent)


def closed_batches(runs: DataFrame) -> DataFrame:
    """batch, state: open while a run is queued or running, failed if any failed, else succeeded."""
    has = lambda *names: F.bool_or(F.col("status").isin(*names))
    return runs.groupBy("batch").agg(F.when(has("queued", "running"), "open").when(has("failed"), "failed").otherwise("succeeded").alias("state"))


def recovery_plan(spark, first: str, last: str, extractors: list[str], attempts: DataFrame) -> DataFrame:
    """day, extractor, outcome of the latest attempt by round, ``planned`` where there is none. The plan is days by a fixed list."""
    days = spark.range(1).select(F.explode(F.expr(f"sequence(date'{first}', date'{last}', interval 1 day)")).alias("day"))
    plan = days.select("day", F.explode(F.array(*map(F.lit, extractors))).alias("extractor"))
    newest = attempts.groupBy("day", "extractor").agg(F.max_by("outcome", "round").alias("outcome"))
    return plan.join(newest, ["day", "extractor"], "left").withColumn("outcome", F.coalesce("outcome", F.lit("planned")))


def summary_state(states: DataFrame, stays: DataFrame, today: Column) -> DataFrame:
    """admission, badge: none, outdated when what is covered ends before the discharge or today, else current."""
    until = F.least(today, F.coalesce(F.col("ended"), today))
    badge = F.when(F.col("coverage_end").isNull(), "none").when(F.col("coverage_end") < until, "outdated").otherwise("current")
    return stays.join(states, "admission", "left").select("admission", badge.alias("badge"))


def pinned_events(events: DataFrame, start: Column, end: Column, cutoff: Column) -> DataFrame:
    """Events of days [start, end] that had happened by ``cutoff``: what a run sees does not grow while it works."""
    return events.filter((F.col("happened_at") >= start) & (F.col("happened_at") < F.date_add(end, 1)) & (F.col("happened_at") <= cutoff))


def reusable(states: DataFrame) -> DataFrame:
    """States with whether an update can reuse them: coverage reaches the target."""
    return states.withColumn("reuse", (F.col("mode") == "update") & F.coalesce(F.col("coverage_end") >= F.col("target_end_date"), F.lit(False)))


def same_identity(rows: DataFrame, wanted: str, found: str) -> DataFrame:
    """Rows with whether both record numbers are the same digits, and not blank."""
    plain = lambda c: F.ltrim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "[^0-9]", ""), F.lit("0"))
    return rows.withColumn("same", (plain(wanted) == plain(found)) & (plain(wanted) != ""))


#: Orders of the official list that a user may ask for; any other is by id.
CENSUS_ORDERS = ("tempo_asc", "tempo_desc", "unidade", "especialidade")


def official_census(records: DataFrame, wards: DataFrame, day: str | None = None, unit: str = "", specialty: str = "", order: str = "") -> DataFrame:
    """The records (id, day, unidade, quarto_leito, especialidade, tempo_internacao) of a day, else of the newest one, with ward names and places in the order asked for.

    A day that is no date counts as none. Lengths of stay are texts such as "5 dias", ordered by their digits, none as 0. Ties are by id.
    """
    wanted = records.sparkSession.range(1).select(F.lit(day).try_cast("date").alias("d")).first()["d"] if day else None
    chosen = F.broadcast(records.agg(F.max("day").alias("day")) if wanted is None else records.sparkSession.createDataFrame([(wanted,)], "day date"))  # one row
    rows = records.join(chosen, "day", "left_semi")
    for column, value in (("unidade", unit.strip()), ("especialidade", specialty.strip())):
        rows = rows.filter(F.col(column) == value) if value else rows
    stay = number_in(F.col("tempo_internacao"))
    by = {"tempo_asc": [stay.asc()], "tempo_desc": [stay.desc()], "unidade": [F.col("unidade"), F.col("quarto_leito")], "especialidade": [F.col("especialidade"), F.col("unidade")]}
    return with_name(placed(rows, [*by.get(order, []), F.col("id")]), wards, "unidade", "ward")
