"""Census stock and flow over the ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.flow import average_daily_census, calendar, hospital_flow
from tidewell.session import table


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    occupied = F.col("event_type").isin("click", "view") & (F.col("value") >= 35)
    adc = average_daily_census(events, F.date_trunc("hour", "ts"), occupied)
    is_type = lambda kind: F.count_if(F.col("event_type") == kind)
    flows = events.groupBy(F.to_date("ts").alias("day")).agg(
        is_type("signup").alias("admissions"), is_type("purchase").alias("discharges"), is_type("error").alias("deaths")
    )
    return hospital_flow(calendar(spark, "2023-12-31", "2024-02-01"), adc, flows)


QUERIES = {"hospital_flow": flow}

SQL = {
    "hospital_flow": """
WITH days AS (SELECT CAST(d AS DATE) AS day FROM generate_series(DATE '2023-12-31', DATE '2024-02-01', INTERVAL 1 DAY) t(d)),
caps AS (SELECT date_trunc('hour', ts) AS h, count(*) AS occupied FROM events
         WHERE event_type IN ('click', 'view') AND value >= 35 GROUP BY 1),
adc AS (SELECT CAST(h AS DATE) AS day, avg(occupied) AS adc, count(*) AS captures FROM caps GROUP BY 1),
fl AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'signup') AS admissions,
       count(*) FILTER (event_type = 'purchase') AS discharges, count(*) FILTER (event_type = 'error') AS deaths
       FROM events GROUP BY 1),
j AS (SELECT day, adc, coalesce(captures, 0)::BIGINT AS captures, coalesce(admissions, 0)::BIGINT AS admissions,
      coalesce(discharges, 0)::BIGINT AS discharges, coalesce(deaths, 0)::BIGINT AS deaths
      FROM days LEFT JOIN adc USING (day) LEFT JOIN fl USING (day)),
n AS (SELECT *, admissions - discharges - deaths AS net_flow, adc - lag(adc) OVER (ORDER BY day) AS delta FROM j)
SELECT *, delta - net_flow AS residual FROM n""",
}
