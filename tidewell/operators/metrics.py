"""Counts, rates and averages of the reporting screens, each as one aggregate where the screens run a query for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dense_counts(rows: DataFrame, keys: list[str], by: str, values: list) -> DataFrame:
    """A column for each of ``values``, 0 where a key has none."""
    counts = [F.count_if(F.col(by) == v).alias(str(v)) for v in values]
    return rows.groupBy(*keys).agg(*counts) if keys else rows.agg(*counts)


def share_after(rows: DataFrame, key: str, hour: Column, after: int) -> DataFrame:
    """Rows with a filled key: total, those at or after the hour, and their share in per cent."""
    filled = rows.filter(F.coalesce(F.col(key), F.lit("")) != "")
    out = filled.groupBy(key).agg(F.count("*").alias("total"), F.count_if(hour >= after).alias("late"))
    return out.withColumn("pct", F.col("late") * 100.0 / F.col("total"))


def weekday_means(days: DataFrame, day: str, value: str) -> DataFrame:
    """Seven rows, Monday 0: the mean and the number of days seen, 0.0 where there is none."""
    means = days.groupBy(F.weekday(day).alias("weekday")).agg(F.avg(value).alias("_mean"), F.count(value).alias("_n"))
    seven = days.sparkSession.range(7).select(F.col("id").cast("int").alias("weekday"))
    return seven.join(means, "weekday", "left").select("weekday", F.coalesce("_mean", F.lit(0.0)).alias("mean"), F.coalesce("_n", F.lit(0)).alias("days"))


def rate(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    """Per cent, ``empty`` where the whole is 0."""
    return F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(empty).cast("double"))


def run_metrics(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs (status, timed_out, started, finished): total, success and timeout rates, mean, least and most seconds.

    Durations are of runs that have both moments.
    """
    seconds = (F.unix_micros(F.col("finished").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1e6
    total = F.count("*")
    columns = [
        total.alias("total"), rate(F.count_if(F.col("status") == "succeeded"), total).alias("success_pct"), rate(F.count_if("timed_out"), total).alias("timeout_pct"),
        F.avg(seconds).alias("mean_seconds"), F.min(seconds).alias("min_seconds"), F.max(seconds).alias("max_seconds"),
    ]
    return runs.groupBy(*keys).agg(*columns) if keys else runs.agg(*columns)


def batch_metrics(attempts: DataFrame, batch: str) -> DataFrame:
    """Attempts (status, worker, started, finished) of each batch: counts, workers, drain time, throughput a minute, mean concurrency.

    Throughput counts runs that ended either way; both are 0 while nothing has drained.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    busy = (micros("finished") - micros("started")) / 1e6
    out = attempts.groupBy(batch).agg(
        F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "running").alias("running"),
        F.array_join(F.array_sort(F.collect_set("worker")), ",").alias("workers"), F.sum(busy).alias("_busy"),
        ((F.max(micros("finished")) - F.min(micros("started"))) / 1e6).alias("drain_seconds"),
    )
    some = F.col("drain_seconds") > 0
    ended = F.col("succeeded") + F.col("failed")
    return out.withColumns({
        "throughput": F.when(some, ended / (F.col("drain_seconds") / 60)).otherwise(0.0),
        "mean_concurrency": F.when(some, F.col("_busy") / F.col("drain_seconds")).otherwise(0.0),
    }).drop("_busy")


def eligible_summary(measurements: DataFrame, day: str, eligible: Column, value: str) -> DataFrame:
    """Daily mean, least and most over eligible measurements of equal weight, and bounds of all; nulls where none is eligible."""
    v = F.when(eligible, F.col(value))
    return measurements.groupBy(day).agg(
        F.count("*").alias("measurements"), F.count(v).alias("eligible"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.min("captured_at").alias("first_captured_at"), F.max("captured_at").alias("last_captured_at"),
    )


def longest_per_key(rows: DataFrame, keys: list[str], text: str, order: str) -> DataFrame:
    """Of each key the row with the longest text, the first of equals, with where the key first came."""
    best = F.min_by(F.struct(*rows.columns), F.struct(-F.length(text), F.col(order)))
    return rows.groupBy(*keys).agg(best.alias("_best"), F.min(order).alias("first_place")).select("_best.*", "first_place")


def worst_status(rows: DataFrame, key: str, status: str, order: tuple[str, ...]) -> DataFrame:
    """The first of ``order`` that any row of the key has."""
    rules = None
    for name in order:
        some = F.bool_or(F.col(status) == name)
        rules = F.when(some, name) if rules is None else rules.when(some, name)
    return rows.groupBy(key).agg(rules.alias(status))


def sector_history(stays: DataFrame, sector: str, start: str, end: str, today: Column, long_days: int = 15) -> DataFrame:
    """For each sector: patients seen, those present and gone, the mean stay of the gone, long stays among the present, and entries without exit."""
    gone, days = F.col(end) <= today, F.datediff(F.least(F.coalesce(F.col(end), today), today), F.col(start))
    counted = lambda c: F.count(F.when(c, 1))
    present = F.coalesce(~gone, F.lit(True))
    return stays.filter(F.col(start) <= today).groupBy(sector).agg(
        F.count("*").alias("entries"), counted(gone).alias("exits"), counted(present).alias("present"), (F.count("*") - counted(gone)).alias("net"),
        F.avg(F.when(gone, days)).alias("mean_stay"), counted(present & (days > long_days)).alias("long_stays"),
    )


def dashboard(snapshots: DataFrame, patients: DataFrame, admissions: DataFrame, discharges: DataFrame, deaths: DataFrame, official: DataFrame, today: Column) -> DataFrame:
    """One row of tiles: the newest capture's occupied beds and sectors and its moment, patients, what left today, and of each daily table its newest row.

    ``snapshots``: captured_at, sector, status; the daily tables: day, n; ``official``: a row for each record of a day. Each table is aggregated to
    a row before they are put side by side. Where a table is empty its number is 0 and its day today.
    """
    newest = snapshots.groupBy("captured_at").agg(F.count_if(F.col("status") == "occupied").alias("present"), F.count_distinct("sector").alias("sectors"))
    row = newest.agg(F.max("captured_at").alias("captured_at"), *[F.coalesce(F.max_by(c, "captured_at"), F.lit(0)).alias(c) for c in ("present", "sectors")])
    row = row.crossJoin(patients.agg(F.count("*").alias("patients")))
    row = row.crossJoin(discharges.agg(F.coalesce(F.max(F.when(F.col("day") == today, F.col("n"))), F.lit(0)).alias("discharged_today")))
    counted = official.groupBy("day").agg(F.count("*").alias("n"))
    for name, days in (("admissions", admissions), ("deaths", deaths), ("discharges", discharges), ("official", counted)):
        row = row.crossJoin(days.agg(F.coalesce(F.max_by("n", "day"), F.lit(0)).alias(name), F.coalesce(F.max("day"), today).alias(f"{name}_day")))
    return row
