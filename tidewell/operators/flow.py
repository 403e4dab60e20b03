"""Stock against flow on one calendar: average daily census, admissions, discharges and deaths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def calendar(df_spark, start: str, end: str) -> DataFrame:
    """Every day from ``start`` to ``end``, both included."""
    days = f"explode(sequence(date'{start}', date'{end}', interval 1 day)) AS day"
    return df_spark.range(1).selectExpr(days)


def average_daily_census(census: DataFrame, captured_at: Column, occupied: Column) -> DataFrame:
    """Mean of occupied rows per capture and day; captures without an occupied row do not count."""
    captures = (
        census.filter(occupied)
        .groupBy(captured_at.alias("captured_at"))
        .agg(F.count("*").alias("occupied"))
    )
    return captures.groupBy(F.to_date("captured_at").alias("day")).agg(
        F.avg("occupied").alias("adc"), F.count("*").alias("captures")
    )


def hospital_flow(days: DataFrame, adc: DataFrame, flows: DataFrame) -> DataFrame:
    """Days x average census x daily counts, with the change, the net flow and what neither explains.

    ``flows`` has a row per day at most with admissions, discharges and deaths. A change is null
    unless the calendar day before has a census. The window runs over a calendar, not over facts.
    """
    by_day = Window.orderBy("day")
    joined = days.join(adc, "day", "left").join(flows, "day", "left")
    counts = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("admissions", "discharges", "deaths")}
    out = joined.withColumns(counts | {"captures": F.coalesce("captures", F.lit(0)).cast("long")})
    out = out.withColumn("net_flow", F.col("admissions") - F.col("discharges") - F.col("deaths"))
    out = out.withColumn("delta", F.col("adc") - F.lag("adc").over(by_day))
    return out.withColumn("residual", F.col("delta") - F.col("net_flow"))
