"""Occupancy of capacity groups under versioned catalogs, from raw bed rows to daily statistics.

Rows have run, captured_at, id, code, name, bed, status, record, patient and band. A catalog is rows of group, policy,
capacity, code and selector. Policies: ``standard`` groups are rated; others are shown only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.amounts import percentage
from tidewell.functions.identity import synthetic_key
from tidewell.functions.strings import collapsed


def run_rows(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of succeeded runs, each with the run's earliest moment of capture as captured_at."""
    good = runs.filter("status = 'succeeded'").select("run")
    first = rows.groupBy("run").agg(F.min("captured_at").alias("_first"))
    return rows.join(good, "run", "left_semi").join(first, "run").withColumn("captured_at", F.col("_first")).drop("_first")


def algorithm_version(catalog: DataFrame, declared: Column) -> DataFrame:
    """Of each catalog: as declared, else v2 where a selector names a band, else v1."""
    by_band = F.bool_or(F.col("selector") != "all")
    return catalog.groupBy("catalog").agg(F.coalesce(F.max(declared), F.when(by_band, "occupancy-v2").otherwise("occupancy-v1")).alias("version"))


def positions(rows: DataFrame) -> DataFrame:
    """One row for each run, source and bed: kind is position, conflict or unidentified (a row without a bed, one by one).

    Equal observations of a bed are one position and duplicates; differing ones are a conflict without a winner. What
    a row says is its status and, when occupied, the record, patient and band. The first row by id gives code and name.
    """
    bed, code = collapsed(F.coalesce("bed", F.lit(""))), F.coalesce("code", F.lit(""))
    source = F.when(code != "", collapsed(code)).otherwise(collapsed(F.col("name")))
    said = F.concat_ws("\x1f", "status", collapsed(F.col("record")), collapsed(F.col("patient")), "band")
    marked = rows.withColumns({"_bed": bed, "_source": source, "_said": F.when(F.col("status") == "occupied", said).otherwise(F.col("status"))})
    alone = F.when(F.col("_bed") == "", F.col("id"))
    grouped = marked.groupBy("run", "_source", "_bed", alone.alias("_alone")).agg(
        F.count("*").alias("rows"), F.count_if(F.col("status") == "occupied").alias("occupied_rows"), (F.min("_said") != F.max("_said")).alias("_differ"),
        F.min_by(F.struct("code", "name", "status", "band"), "id").alias("_first"),
    )
    kind = F.when(F.col("_bed") == "", "unidentified").when(F.col("_differ"), "conflict").otherwise("position")
    return grouped.select("run", kind.alias("kind"), "rows", "occupied_rows", "_first.*")


def grouped_positions(places: DataFrame, catalog: DataFrame) -> DataFrame:
    """Positions with group, policy and capacity: by code and band where the code is split by age, with ``unknown_age`` for those of a
    split code whose band is unknown. Codes without a group are under a key of their own, as are names of rows without a code; what no band of
    a split code takes has no group."""
    split = catalog.filter("selector <> 'all'").select("code").distinct().withColumn("_split", F.lit(True))
    members = catalog.select(F.col("code").alias("_code"), "selector", "group", "policy", "capacity")
    p = places.filter("kind = 'position'").join(split, "code", "left")
    unknown = F.coalesce("_split", F.lit(False)) & (F.col("band") == "unknown") & (F.col("status") == "occupied")
    p = p.withColumn("unknown_age", unknown)
    out = p.join(members, (F.col("code") == F.col("_code")) & ((F.col("selector") == "all") | (F.col("selector") == F.col("band"))), "left")
    coded = F.coalesce("code", F.lit("")) != ""
    key = synthetic_key(F.when(coded, "code").otherwise("blank"), F.when(coded, F.col("code")).otherwise(F.coalesce("name", F.lit(""))))
    return out.withColumn("group", F.coalesce("group", F.when(F.col("_split").isNull(), key))).drop("_code", "_split", "selector")


def group_measurements(grouped: DataFrame, catalog: DataFrame, runs: DataFrame) -> DataFrame:
    """Every run and group of the catalog, seen or not, and groups without one: occupied, percentage, exceeded_by, availability, status.

    Only standard groups with a capacity are calculated; a capacity of 0 has no percentage.
    """
    definitions = catalog.groupBy("group").agg(F.first("policy").alias("policy"), F.first("capacity").alias("capacity"))
    counts = grouped.filter("group IS NOT NULL").groupBy("run", "group").agg(F.count_if((F.col("status") == "occupied") & ~F.col("unknown_age")).alias("_n"), F.count("*").alias("positions"))
    wanted = runs.select("run").distinct().crossJoin(definitions)  # a catalog's groups, a few for each run
    out = wanted.join(counts, ["run", "group"], "full")
    occupied = F.coalesce("_n", F.lit(0))
    rated = (F.col("policy") == "standard") & F.col("capacity").isNotNull()
    over = F.greatest(occupied - F.col("capacity"), F.lit(0))
    return out.select(
        "run", "group", F.coalesce("policy", F.lit("unmapped")).alias("policy"), "capacity", occupied.alias("occupied"), F.coalesce("positions", F.lit(0)).alias("positions"),
        F.when(rated, percentage(occupied, F.col("capacity"))).alias("pct"), F.when(rated, over).alias("exceeded_by"),
        F.when(rated, F.greatest(F.col("capacity") - occupied, F.lit(0))).alias("availability"), F.when(rated, "calculated").otherwise("not_calculated").alias("status"),
    )


def hospital_totals(groups: DataFrame, by_group: bool = True) -> DataFrame:
    """Of each run: known and calculable capacity, occupied_for_rate, pct, exceeded_by and availability.

    ``by_group`` sums what each group exceeds, so that a free bed of one group makes up for none of another; otherwise totals are compared.
    """
    rated = F.col("status") == "calculated"
    out = groups.groupBy("run").agg(
        F.coalesce(F.sum("capacity"), F.lit(0)).alias("known_capacity"), F.coalesce(F.sum(F.when(rated, F.col("capacity"))), F.lit(0)).alias("calculable_capacity"),
        F.coalesce(F.sum(F.when(rated, F.col("occupied"))), F.lit(0)).alias("occupied_for_rate"), F.coalesce(F.sum("exceeded_by"), F.lit(0)).alias("_over"),
        F.coalesce(F.sum("availability"), F.lit(0)).alias("availability"),
    )
    whole = F.greatest(F.col("occupied_for_rate") - F.col("calculable_capacity"), F.lit(0))
    over = F.col("_over") if by_group else whole
    return out.withColumns({"pct": percentage(F.col("occupied_for_rate"), F.col("calculable_capacity")), "exceeded_by": over}).drop("_over")


def reconciliation(rows: DataFrame, places: DataFrame, grouped: DataFrame) -> DataFrame:
    """Of each run where its occupied rows are: duplicates, conflicts, without a bed, unknown age, outside rated groups, in the numerator.

    The parts sum to raw_occupied_rows.
    """
    raw = rows.groupBy("run").agg(F.count_if(F.col("status") == "occupied").alias("raw_occupied_rows"))
    occupied = F.col("occupied_rows")
    n = lambda kind, value: F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0))
    bridge = places.groupBy("run").agg(
        n("position", F.greatest(occupied - 1, F.lit(0))).alias("duplicate_occupied_rows"), n("conflict", occupied).alias("conflict_occupied_rows"),
        n("unidentified", occupied).alias("unidentified_occupied_rows"), F.count_if(F.col("kind") == "conflict").alias("conflict_positions"),
    )
    busy, rated = F.col("status") == "occupied", F.coalesce(F.col("policy") == "standard", F.lit(False))
    parts = grouped.groupBy("run").agg(
        F.count_if(busy & F.col("unknown_age")).alias("unknown_age_rows"), F.count_if(busy & ~F.col("unknown_age") & ~rated).alias("outside_calculable"),
        F.count_if(busy & ~F.col("unknown_age") & rated).alias("official_numerator"),
    )
    out = raw.join(bridge, "run", "left").join(parts, "run", "left").na.fill(0)
    partial = (F.col("conflict_positions") > 0) | (F.col("unidentified_occupied_rows") > 0)
    return out.withColumns({"age_partial": F.col("unknown_age_rows") > 0, "position_partial": partial})


def is_eligible(version: Column, age_partial: Column, position_partial: Column) -> Column:
    """Whether a measurement counts for the day: whole positions, and from v2 on no unknown age."""
    return ~F.coalesce(position_partial, F.lit(False)) & ((version == "occupancy-v1") | ~F.coalesce(age_partial, F.lit(False)))


def new_measurements(computed: DataFrame, stored: DataFrame) -> DataFrame:
    """Those of runs that have none yet: a measurement never changes."""
    return computed.join(stored.select("run").distinct(), "run", "left_anti")


def catalog_violations(groups: DataFrame, members: DataFrame) -> DataFrame:
    """rule, key of all that breaks a rule: groups (group, policy, capacity) and members (group, code, selector)."""
    rule = lambda df, name, key: df.select(F.lit(name).alias("rule"), F.col(key).cast("string").alias("key"))
    twice = groups.groupBy("group").count().filter("count > 1")
    policy = groups.filter("(policy = 'standard' AND (capacity IS NULL OR capacity <= 0)) OR (policy <> 'standard' AND capacity <= 0)")
    use = members.groupBy("code").agg(F.sort_array(F.collect_list("selector")).alias("s"), F.count_distinct("group").alias("g"))
    whole = (F.size("s") == 1) & (F.col("s")[0] == "all")
    pair = (F.array_join("s", ",") == "age_12_or_over,under_12") & (F.col("g") == 2)
    empty = groups.select("group").distinct().join(members.select("group").distinct(), "group", "left_anti")
    return rule(twice, "group_twice", "group").union(rule(policy, "policy_capacity", "group")).union(rule(use.filter(~whole & ~pair), "code_selectors", "code")).union(rule(empty, "group_without_code", "group"))
