"""What a catalog covers of what was observed: sectors counted, components of groups, and the hospital's day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.presentation import _map


def _code() -> Column:
    return F.coalesce(F.trim("code"), F.lit(""))


def sector_counts(rows: DataFrame, catalog: DataFrame, by: str = "run") -> DataFrame:
    """by, observed_sectors, covered_sectors, calculable_sectors: a sector is its code, or its name where it has none.

    Covered are codes of a group with a capacity, calculable those of a standard group; a code split by age is one sector.
    """
    known = catalog.groupBy(F.col("code").alias("_of")).agg(F.bool_or(F.col("capacity").isNotNull()).alias("_covered"), F.bool_or(F.col("policy") == "standard").alias("_rated"))
    seen = rows.select(by, _code().alias("_of"), F.when(_code() == "", F.coalesce("name", F.lit(""))).alias("_name")).distinct()
    seen = seen.join(known, "_of", "left")
    return seen.groupBy(by).agg(F.count("*").alias("observed_sectors"), F.count_if("_covered").alias("covered_sectors"), F.count_if("_rated").alias("calculable_sectors"))


def components(places: DataFrame, catalog: DataFrame, runs: DataFrame, unmapped: DataFrame) -> DataFrame:
    """run, group, configured_code, configured_name, selector, observed_code, observed_name, status_counts, name_mismatch: what a group's numbers are made of.

    A catalog (group, code, selector, name) has a row for each member and each name it was observed under, or one without a name. A name that
    isn't the configured one is said and changes nothing. ``unmapped`` (run, group, code, name, status) are positions of groups that no catalog has.
    """
    members = catalog.select("group", F.col("code").alias("configured_code"), F.col("name").alias("configured_name"), "selector")
    counts = places.filter("kind = 'position'").select("run", _code().alias("_code"), "name", "band", "status").filter("_code <> ''")
    counts = counts.groupBy("run", "_code", "band", "name", "status").agg(F.count("*").alias("n"))
    fits = (F.col("_code") == F.col("configured_code")) & ((F.col("selector") == "all") | (F.col("selector") == F.col("band")))
    names = counts.join(members, fits).groupBy("run", "group", "configured_code", "selector", F.col("name").alias("observed_name"), "status").agg(F.sum("n").alias("n"))
    names = names.groupBy("run", "group", "configured_code", "selector", "observed_name").agg(_map("status", F.col("n")).alias("status_counts"))
    wanted = runs.select("run").distinct().crossJoin(members)  # a catalog's members, a few for each run
    out = wanted.join(names, ["run", "group", "configured_code", "selector"], "left").withColumn("observed_code", F.col("configured_code"))
    other = unmapped.groupBy("run", "group", _code().alias("observed_code"), F.col("name").alias("observed_name"), "status").agg(F.count("*").alias("n"))
    other = other.groupBy("run", "group", "observed_code", "observed_name").agg(_map("status", F.col("n")).alias("status_counts"))
    out = out.unionByName(other, allowMissingColumns=True)
    differs = F.col("configured_code").isNotNull() & F.col("observed_name").isNotNull() & ~F.col("observed_name").eqNullSafe(F.col("configured_name"))
    none = F.create_map().cast("map<string,bigint>")
    return out.select(
        "run", "group", "configured_code", "configured_name", "selector", "observed_code", "observed_name",
        F.coalesce("status_counts", none).alias("status_counts"), differs.alias("name_mismatch"),
    )


def daily_hospital(measurements: DataFrame, day: str, at: str, eligible: Column) -> DataFrame:
    """A row for each day, of hospital totals with partial marks and counts of sectors.

    Occupied and percentages are of the eligible measurements, each of one weight, and null where there is none; captures, exclusions and the
    bounds of sectors are of all. Capacities are those of the first eligible one, else of the first. Means have two digits, halves away from nought.
    """
    of = lambda c: F.when(eligible, c)
    share = F.col("occupied_for_rate").cast("decimal(20,6)") * 100 / F.nullif(F.col("calculable_capacity"), F.lit(0))
    n, pct = of(F.col("occupied_for_rate")), of(share)
    two = lambda c: F.round(c, 2).cast("decimal(12,2)")
    first = F.min_by(F.struct("known_capacity", "calculable_capacity"), F.struct(~eligible, F.col(at)))
    bounds = [f(c).alias(f"{name}_{c}") for c in ("observed_sectors", "covered_sectors", "calculable_sectors") for name, f in (("min", F.min), ("max", F.max))]
    out = measurements.groupBy(day).agg(
        F.count("*").alias("measurements"), F.count_if(eligible).alias("eligible"), F.count_if("age_partial").alias("age_excluded"), F.count_if("position_partial").alias("position_excluded"),
        F.min(at).alias("first_captured_at"), F.max(at).alias("last_captured_at"), first.alias("_first"),
        two(F.avg(n.cast("decimal(20,6)"))).alias("mean_occupied"), F.min(n).alias("min_occupied"), F.max(n).alias("max_occupied"),
        two(F.avg(pct)).alias("mean_pct"), two(F.min(pct)).alias("min_pct"), two(F.max(pct)).alias("max_pct"), F.max(of(F.col("exceeded_by"))).alias("max_exceeded_by"), *bounds,
    )
    return out.select(day, "_first.*", *[c for c in out.columns if c not in (day, "_first")])
