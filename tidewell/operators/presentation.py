"""Nested views of a census: counters that merge, daily summaries of groups, groups with their beds, and sectors with their positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.strings import collapsed

#: The group of beds that a code split by age has and no group takes (fixed values).
AUXILIARY, AUXILIARY_STATUS = "AUX-3A-UNCLASSIFIED", "auxiliary"


def _map(key: str, value: Column, where: Column | None = None) -> Column:
    """A map of a group's keys, in their order, of rows that ``where`` holds for."""
    entry = F.struct(F.col(key).alias("key"), value.alias("value"))
    entries = F.collect_list(entry if where is None else F.when(where, entry))
    return F.map_from_entries(F.array_sort(entries, lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0)))


def observed_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, code, band, name, status, n: what was observed. A row with a code counts for it and for its band, one without for its name alone."""
    code = F.coalesce(F.trim("code"), F.lit(""))
    return rows.groupBy(*by, code.alias("code"), F.when(code != "", F.col("band")).alias("band"), "name", "status").agg(F.count("*").alias("n"))


def merged_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """Counts of several captures as those of a coarser key, such as a day; sums may be summed again in any order."""
    return counts.groupBy(*by, "code", "band", "name", "status").agg(F.sum("n").alias("n"))


def nested_counters(counts: DataFrame, by: list[str]) -> DataFrame:
    """by, by_code, by_band, blank_by_name: counters code -> name -> status, (code, band) -> name -> status, and name -> status without a code.

    Each level is an aggregate of its own, so that no task sees more than one key's names.
    """
    blank = F.col("code") == ""
    part = F.when(blank, F.lit("blank")).otherwise("code")
    flat = counts.select(*by, part.alias("part"), F.when(~blank, F.col("code")).alias("key"), "name", "status", "n")
    flat = flat.unionByName(counts.filter(~blank).select(*by, F.lit("band").alias("part"), F.concat_ws("|", "code", "band").alias("key"), "name", "status", "n"))
    statuses = flat.groupBy(*by, "part", "key", "name", "status").agg(F.sum("n").alias("n"))
    names = statuses.groupBy(*by, "part", "key", "name").agg(_map("status", F.col("n")).alias("m"))
    keys = names.groupBy(*by, "part", "key").agg(_map("name", F.col("m")).alias("m"))
    of = lambda kind: _map("key", F.col("m"), F.col("part") == kind)
    blank_names = F.first(F.when(F.col("part") == "blank", F.col("m")), ignorenulls=True)
    return keys.groupBy(*by).agg(of("code").alias("by_code"), of("band").alias("by_band"), blank_names.alias("blank_by_name"))


def with_status_counts(measurements: DataFrame, grouped: DataFrame, by: list[str]) -> DataFrame:
    """Measurements of groups with a map of positions by status; occupied is null where the group is not calculated."""
    counts = grouped.groupBy(*by, "group", "status").agg(F.count("*").alias("n")).groupBy(*by, "group").agg(_map("status", F.col("n")).alias("status_counts"))
    occupied = F.when(F.col("status") == "calculated", F.col("occupied"))
    empty = F.create_map().cast("map<string,bigint>")
    return measurements.withColumn("occupied", occupied).join(counts, [*by, "group"], "left").withColumn("status_counts", F.coalesce("status_counts", empty))


def daily_groups(measurements: DataFrame, day: str, at: str, eligible: Column) -> DataFrame:
    """A row for each day and group, from the eligible measurements, all of one weight.

    Occupied falls back to what the status counts say. Percentages are of measurements with a capacity and a count; policy, status
    and capacity are those of the first one. Means have two digits, halves away from nought.
    """
    rows = measurements.filter(eligible).withColumns({
        "_n": F.coalesce("occupied", F.get(F.map_values(F.map_filter("status_counts", lambda k, _: k == "occupied")), F.lit(0)), F.lit(0)),
        "_pct": F.when(F.col("capacity").isNotNull() & F.col("occupied").isNotNull(), F.col("occupied").cast("decimal(20,6)") * 100 / F.nullif(F.col("capacity"), F.lit(0))),
    })
    two = lambda c: F.round(c, 2).cast("decimal(12,2)")
    first = F.min_by(F.struct("policy", "status", "capacity"), at).alias("_first")
    out = rows.groupBy(day, "group").agg(
        F.count("*").alias("measurements"), F.min(at).alias("first_captured_at"), F.max(at).alias("last_captured_at"), first,
        two(F.avg(F.col("_n").cast("decimal(20,6)"))).alias("mean_occupied"), F.min("_n").alias("min_occupied"), F.max("_n").alias("max_occupied"),
        two(F.avg("_pct")).alias("mean_pct"), two(F.min("_pct")).alias("min_pct"), two(F.max("_pct")).alias("max_pct"), F.max("exceeded_by").alias("max_exceeded_by"),
    )
    return out.select(day, "group", "_first.*", *[c for c in out.columns if c not in (day, "group", "_first")])


def exact_measurement(rows: DataFrame, measurements: DataFrame, census: str) -> DataFrame:
    """census, run: the run whose measurement a census is shown with. All its rows must come from one run, none without, and that run must have a measurement."""
    runs = rows.groupBy(census).agg(F.count_distinct("run").alias("_n"), F.min("run").alias("run"), F.bool_or(F.col("run").isNull()).alias("_none"))
    return runs.filter("_n = 1 AND NOT _none").select(census, "run").join(measurements.select("run").distinct(), "run", "left_semi").select(census, "run")


def _bed() -> Column:
    """A bed as it is shown: who lies in it is said of occupied ones alone."""
    busy = F.col("status") == "occupied"
    return F.struct(F.col("bed"), F.col("status"), F.when(busy, F.col("patient")).otherwise("").alias("patient"), F.when(busy, F.col("record")).otherwise("").alias("record"), "id")


def group_presentation(rows: DataFrame, catalog: DataFrame, measurements: DataFrame) -> DataFrame:
    """run, group, policy, capacity, occupied, pct, status_counts, source_sectors, beds: every measured group with the beds that fall into it.

    Beds of a code split by age go to the group of their band when occupied; the others of such a code make one auxiliary row without capacity or
    rate. Nothing measured is computed again. Beds whose code no group has are not shown. A group's beds are one array, in the order of ids.
    """
    split = catalog.filter("selector <> 'all'").select(F.col("code").alias("_code")).distinct().withColumn("_split", F.lit(True))
    members = catalog.select(F.col("code").alias("_of"), "selector", F.col("group").alias("_group"))
    code = F.coalesce(F.trim("code"), F.lit(""))
    b = rows.withColumn("code", code).join(split, F.col("code") == F.col("_code"), "left")
    b = b.withColumn("_split", F.coalesce("_split", F.lit(False)))
    selector = F.when(~F.col("_split"), "all").when(F.col("status") == "occupied", F.col("band"))
    b = b.withColumn("_selector", selector).join(members, (F.col("code") == F.col("_of")) & (F.col("_selector") == F.col("selector")), "left")
    b = b.withColumn("group", F.coalesce("_group", F.when(F.col("_split"), F.lit(AUXILIARY)))).filter("group IS NOT NULL")
    beds = b.groupBy("run", "group").agg(
        F.array_sort(F.collect_list(_bed()), lambda x, y: F.when(x["id"] < y["id"], -1).when(x["id"] > y["id"], 1).otherwise(0)).alias("beds"),
        F.array_sort(F.array_compact(F.collect_set(F.nullif(F.col("name"), F.lit(""))))).alias("source_sectors"),
    )
    own = F.map_from_entries(F.array_sort(F.transform(F.array_distinct(F.transform("beds", lambda x: x["status"])), lambda s: F.struct(s.alias("key"), F.size(F.filter("beds", lambda x: x["status"] == s)).cast("long").alias("value")))))
    shown = measurements.select("run", "group", "policy", "capacity", "occupied", "pct", "status_counts")
    out = shown.join(beds, ["run", "group"], "left")
    extra = beds.filter(F.col("group") == AUXILIARY).select("run", "group", F.lit(AUXILIARY_STATUS).alias("policy"), *[F.lit(None).cast(shown.schema[c].dataType).alias(c) for c in ("capacity", "occupied", "pct")], own.alias("status_counts"), "beds", "source_sectors")
    out = out.unionByName(extra)
    return out.withColumns({"beds": F.coalesce("beds", F.array().cast(out.schema["beds"].dataType)), "source_sectors": F.coalesce("source_sectors", F.array().cast("array<string>"))})


def sector_presentation(rows: DataFrame) -> DataFrame:
    """run, source, code, name, positions_by_status, conflict_positions, duplicate_extra_rows, unidentified_rows, positions: sectors of a capture.

    The rules are those of ``occupancy.positions``: equal observations of a bed are one position, differing ones a conflict without a
    patient, rows without a bed are counted and are no positions. A sector is its code, or its name without one; its first row by id names it.
    """
    code, bed = F.coalesce(F.trim("code"), F.lit("")), collapsed(F.coalesce("bed", F.lit("")))
    said = F.concat_ws("\x1f", "status", collapsed(F.col("record")), collapsed(F.col("patient")), "band")
    marked = rows.withColumns({"code": code, "_bed": bed, "_source": F.when(code != "", collapsed(code)).otherwise(collapsed(F.col("name"))), "_said": F.when(F.col("status") == "occupied", said).otherwise(F.col("status"))})
    first = F.min_by(F.struct(F.trim("bed").alias("bed"), "status", "patient", "record"), "id")
    beds = marked.filter("_bed <> ''").groupBy("run", "_source", "_bed").agg(F.count("*").alias("_n"), (F.min("_said") != F.max("_said")).alias("conflict"), first.alias("f"))
    status = F.when(F.col("conflict"), "conflict").otherwise(F.col("f.status"))
    busy = status == "occupied"
    place = F.struct(F.col("f.bed").alias("bed"), status.alias("status"), F.when(busy, F.trim("f.patient")).otherwise("").alias("patient"), F.when(busy, F.col("f.record")).otherwise("").alias("record"))
    counted = beds.withColumn("status", status).groupBy("run", "_source", "status").agg(F.count("*").alias("n"), F.sum(F.when(F.col("conflict"), 0).otherwise(F.col("_n") - 1)).alias("extra"), F.collect_list(place).alias("places"))
    sectors = counted.groupBy("run", "_source").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("status") != "conflict", F.struct(F.col("status").alias("key"), F.col("n").alias("value")))))).alias("positions_by_status"),
        F.sum(F.when(F.col("status") == "conflict", F.col("n")).otherwise(0)).alias("conflict_positions"), F.sum("extra").alias("duplicate_extra_rows"),
        F.array_sort(F.flatten(F.collect_list("places"))).alias("positions"),
    )
    named = marked.groupBy("run", "_source").agg(F.min_by(F.struct("code", F.trim("name").alias("name")), "id").alias("f"), F.count_if(F.col("_bed") == "").alias("unidentified_rows"))
    out = named.join(sectors, ["run", "_source"], "left").select("run", F.col("_source").alias("source"), "f.code", "f.name", "positions_by_status", "conflict_positions", "duplicate_extra_rows", "unidentified_rows", "positions")
    none = {"positions_by_status": F.create_map(), "positions": F.array()}
    out = out.withColumns({c: F.coalesce(c, v.cast(out.schema[c].dataType)) for c, v in none.items()})
    return out.na.fill(0, ["conflict_positions", "duplicate_extra_rows"])
