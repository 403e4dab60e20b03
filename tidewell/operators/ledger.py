"""Upserts as joins: each takes what is stored and what came in and returns what to store and what was done.

Without a table format that merges, a caller appends the new rows or overwrites the partitions touched. All are idempotent:
a second run of the same input adds and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ledger_actions(batch: DataFrame, ledger: DataFrame, order: str) -> DataFrame:
    """``batch`` (identity, content) with action: skipped if seen with this content, revised if seen with another, else created.

    Rows see those before them in ``order``, so the second content of one identity in a batch is a revision.
    """
    known = ledger.groupBy("identity").agg(F.lit(1).alias("_known"))
    exact = ledger.select("identity", "content").distinct().withColumn("_exact", F.lit(1))
    by_content = F.row_number().over(Window.partitionBy("identity", "content").orderBy(order))
    rows = batch.withColumn("_nth", by_content).join(exact, ["identity", "content"], "left").join(known, "identity", "left")
    new = F.col("_exact").isNull() & (F.col("_nth") == 1)
    first_new = F.min(F.when(new, F.col(order))).over(Window.partitionBy("identity"))
    created = new & F.col("_known").isNull() & (F.col(order) == first_new)
    action = F.when(~new, "skipped").when(created, "created").otherwise("revised")
    return rows.withColumn("action", action).select(*batch.columns, "action")


def filled_over(stored: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Stored and incoming rows by key: what comes in filled overwrites, blank never does. Keys that are new come with what they have."""
    new = incoming.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = stored.join(new, key, "full")
    return out.select(key, *[F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), F.col(c), F.lit("")).alias(c) for c in columns])


def changes(stored: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, field, old, new: an audit row for each watched column whose filled value differs from a filled one before."""
    new = incoming.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("old"), F.col(f"_{c}").alias("new")) for c in columns])
    rows = stored.join(new, key).select(key, F.explode(pairs).alias("p")).select(key, "p.*")
    return rows.filter((F.coalesce("new", F.lit("")) != "") & (F.coalesce("old", F.lit("")) != "") & (F.col("new") != F.col("old")))


def get_or_create(stored: DataFrame, incoming: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """key, old, new, action of each incoming key: created, renamed or kept. The last name in ``order`` counts, blank ones don't."""
    last = incoming.groupBy(key).agg(F.max_by(F.nullif(F.col(name), F.lit("")), F.when(F.col(name) != "", F.col(order))).alias("new"))
    out = last.join(stored.select(key, F.col(name).alias("old"), F.lit(True).alias("_there")), key, "left")
    renamed = F.col("new").isNotNull() & (F.col("new") != F.col("old"))
    action = F.when(F.col("_there").isNull(), "created").when(renamed, "renamed").otherwise("kept")
    return out.select(key, "old", "new", action.alias("action"))


def reconciled(incoming: DataFrame, stored: DataFrame, entity: str, key: str, start: str, end: str) -> DataFrame:
    """``incoming`` with target and action: matched by key, else by the same period (open with open), else created."""
    by_key = stored.select(F.col(entity).alias("_e"), F.col(key).alias("_k")).distinct()
    period = stored.groupBy(F.col(entity).alias("_pe"), F.col(start).alias("_s"), F.col(end).alias("_t")).agg(F.min(key).alias("_p"))
    out = incoming.join(by_key, (F.col(entity) == F.col("_e")) & (F.col(key) == F.col("_k")), "left")
    out = out.join(period, (F.col(entity) == F.col("_pe")) & (F.col(start) == F.col("_s")) & F.col(end).eqNullSafe(F.col("_t")), "left")
    action = F.when(F.col("_k").isNotNull(), "by_key").when(F.col("_p").isNotNull(), "by_period").otherwise("created")
    return out.select(*incoming.columns, F.coalesce("_k", "_p", key).alias("target"), action.alias("action"))


def survivors(rows: DataFrame, same: list[str], key: str, weight: str) -> DataFrame:
    """key, survivor: of rows equal in ``same`` (nulls equal too) the heaviest stays, then the smallest key."""
    best = rows.groupBy(*same).agg(F.min_by(key, F.struct(-F.col(weight), F.col(key))).alias("survivor"))
    both = None
    for c in same:
        test = rows[c].eqNullSafe(best[c])
        both = test if both is None else both & test
    return rows.join(best, both).select(rows[key].alias(key), "survivor")


def repointed(rows: DataFrame, moves: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """Rows whose ``column`` follows the move from ``old`` to ``new``."""
    m = moves.select(F.col(old).alias("_old"), F.col(new).alias("_new"))
    return rows.join(m, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def replaced(stored: DataFrame, incoming: DataFrame, part: str) -> DataFrame:
    """All rows of the parts that came in are replaced: what a dynamic partition overwrite leaves."""
    return stored.join(incoming.select(part).distinct(), part, "left_anti").unionByName(incoming)


def first_seen_upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], seen: str) -> DataFrame:
    """keys, first_seen_at, last_seen_at and the attributes of the first sight: later sights move last_seen_at only."""
    attributes = [c for c in incoming.columns if c not in (*keys, seen)]
    first = F.struct(*attributes)
    new = incoming.groupBy(*keys).agg(F.min(seen).alias("first_seen_at"), F.max(seen).alias("last_seen_at"), F.min_by(first, F.struct(seen, *attributes)).alias("_a"))
    old = stored.select(*keys, "first_seen_at", "last_seen_at", first.alias("_a"))
    both = old.unionByName(new).groupBy(*keys).agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.min_by("_a", "first_seen_at").alias("_a"))
    return both.select(*keys, "first_seen_at", "last_seen_at", "_a.*")


def updated(stored: DataFrame, incoming: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys with the incoming value where it is not null, else the stored; and action: inserted, updated or unchanged."""
    new = incoming.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_in"))
    out = stored.withColumn("_old", F.lit(True)).join(new, keys, "full")
    differs = F.lit(False)
    for c in columns:
        differs = differs | (F.col(f"_{c}").isNotNull() & ~F.col(f"_{c}").eqNullSafe(F.col(c)))
    action = F.when(F.col("_old").isNull(), "inserted").when(differs, "updated").otherwise("unchanged")
    return out.select(*keys, *[F.coalesce(f"_{c}", c).alias(c) for c in columns], action.alias("action"))


def closures(reports: DataFrame, stays: DataFrame, patients: DataFrame) -> DataFrame:
    """Reports (record, left_on) with action and admission: close the patient's newest open stay, skip if it is closed already,
    open and close one for a patient without, and create the patient too where there is none."""
    newest = stays.groupBy("patient").agg(F.max_by(F.struct("admission", "ended"), F.struct("started", "admission")).alias("_s"))
    out = reports.join(patients.select(F.col("record").alias("_r"), F.col("patient")), F.col("record") == F.col("_r"), "left").join(newest, "patient", "left")
    action = F.when(F.col("patient").isNull(), "create_patient").when(F.col("_s").isNull(), "create_stay").when(F.col("_s.ended").isNotNull(), "already_closed").otherwise("close")
    return out.select(*reports.columns, F.col("_s.admission").alias("admission"), action.alias("action"))


def located(stays: DataFrame, places: DataFrame, entity: str, only_newest: bool = False) -> DataFrame:
    """Open stays with ward and bed of the latest place; a blank one never overwrites. Either all open stays of an entity or its newest."""
    p = places.select(entity, F.col("ward").alias("_ward"), F.col("bed").alias("_bed"))
    open_stay = F.col("ended").isNull()
    if only_newest:
        newest = stays.filter(open_stay).groupBy(entity).agg(F.max_by("admission", F.struct("started", "admission")).alias("_newest"))
        stays = stays.join(newest, entity, "left")
        open_stay = open_stay & (F.col("admission") == F.col("_newest"))
    out = stays.join(p, entity, "left")
    filled = lambda new, old: F.when(open_stay & (F.coalesce(new, F.lit("")) != ""), F.col(new)).otherwise(F.col(old))
    return out.withColumns({"ward": filled("_ward", "ward"), "bed": filled("_bed", "bed")}).drop("_ward", "_bed", "_newest")


def widened(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """key, coverage_start, coverage_end: the least start and the greatest end of both."""
    both = stored.select(key, "coverage_start", "coverage_end").unionByName(incoming.select(key, "coverage_start", "coverage_end"))
    return both.groupBy(key).agg(F.min("coverage_start").alias("coverage_start"), F.max("coverage_end").alias("coverage_end"))


def restored(states: DataFrame, versions: DataFrame, key: str, created: str, value: str) -> DataFrame:
    """States with the value of their newest remaining version, null where none remains."""
    newest = versions.groupBy(key).agg(F.max_by(value, created).alias(value))
    return states.select(key).join(newest, key, "left")


def final_failures(runs: DataFrame, recorded: DataFrame, most_attempts: int) -> DataFrame:
    """Failed runs that have used all attempts, with a batch and a record, and are not recorded yet."""
    spent = runs.filter((F.col("status") == "failed") & (F.col("attempts") >= most_attempts) & F.col("batch").isNotNull() & (F.coalesce("record", F.lit("")) != ""))
    return spent.join(recorded.select("run").distinct(), "run", "left_anti")


def requeued(runs: DataFrame, batches: DataFrame, now: Column) -> DataFrame:
    """Runs with the running ones of the newest open batch queued again."""
    newest = batches.filter("finished IS NULL").agg(F.max_by("batch", F.struct("opened", "batch")).alias("_newest"))
    again = (F.col("status") == "running") & (F.col("batch") == F.col("_newest"))
    out = runs.crossJoin(F.broadcast(newest))  # one row
    return out.withColumns({"queued_at": F.when(again, now).otherwise(F.col("queued_at")), "status": F.when(again, "queued").otherwise(F.col("status"))}).drop("_newest")


def merged(patients: DataFrame, children: DataFrame, moves: DataFrame, key: str, column: str, old: str, new: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Patients merged by ``moves``: the ones that remain, children that point at them, and an audit row for each that went, with the children it gave."""
    gone = moves.filter(F.col(old) != F.col(new))
    left = patients.join(gone.select(F.col(old).alias(key)), key, "left_anti")
    counts = children.groupBy(F.col(column).alias(old)).agg(F.count("*").alias("_n"))
    audit = gone.join(counts, old, "left").select(old, new, F.coalesce("_n", F.lit(0)).alias("moved"))
    return left, repointed(children, moves, column, old, new), audit


def retried(runs: DataFrame, attempts: str, finished: str, wait: str = "60 seconds", most: int = 3) -> DataFrame:
    """Failed ``runs`` with status and next_retry_at: queued again after ``wait`` until they had ``most`` attempts, then failed for good."""
    again = F.col(attempts) < most
    return runs.withColumns({"status": F.when(again, "queued").otherwise("failed"), "next_retry_at": F.when(again, F.col(finished) + F.expr(f"INTERVAL {wait}"))})


def registry_upsert(wards: DataFrame, beds: DataFrame, incoming: DataFrame, name: str = "") -> tuple[DataFrame, DataFrame]:
    """Wards (code, ward, action) and beds (code, bed, status, kind, active, action) after a catalog text of beds (code, ward, bed, status, kind, active) came in.

    Only units whose ward's name contains ``name``, in any case, are taken. What is there already under its code, or its code and bed, is updated,
    the rest created; what did not come in is kept. Of rows that repeat a key the largest values count.
    """
    taken = incoming.filter(F.contains(F.lower("ward"), F.lit(name.lower()))) if name else incoming
    merge = lambda old, new, keys, values: old.select(*keys, F.struct(*values).alias("_old")).join(new.groupBy(*keys).agg(F.max(F.struct(*values)).alias("_new")), keys, "full")
    action = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "created").otherwise("updated").alias("action")
    shown = lambda df, keys: df.select(*keys, F.coalesce("_new", "_old").alias("_v"), action).select(*keys, "_v.*", "action")
    return shown(merge(wards, taken, ["code"], ["ward"]), ["code"]), shown(merge(beds, taken, ["code", "bed"], ["status", "kind", "active"]), ["code", "bed"])
