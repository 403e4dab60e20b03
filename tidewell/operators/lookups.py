"""Joins: dimensions with fallbacks, latest rows, as-of versions, intervals, and the resolver of several steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Spans of one entity that a fact may look through as a list.
SPANS_AT_ONCE = 64


def with_name(facts: DataFrame, names: DataFrame, code: str, name: str) -> DataFrame:
    """``facts`` with the dimension's name, or the code where it has none; of several names of a code the first in order."""
    return facts.join(names.groupBy(code).agg(F.min(name).alias("_name")), code, "left").withColumn(name, F.coalesce("_name", F.col(code).cast("string"))).drop("_name")


def by_code_or_name(facts: DataFrame, dimension: DataFrame, raw: str, code: str, name: str) -> DataFrame:
    """resolved: the name by code, else the name by name, else what stood there. A code wins over a name."""
    codes = dimension.groupBy(F.col(code).alias("_code")).agg(F.min(name).alias("_by_code"))
    names = dimension.select(F.col(name).alias("_by_name")).distinct()
    out = facts.join(codes, F.col(raw) == F.col("_code"), "left").join(names, F.col(raw) == F.col("_by_name"), "left")
    return out.withColumn("resolved", F.coalesce("_by_code", "_by_name", raw)).drop("_code", "_by_code", "_by_name")


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order``, which must be total."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_nth = 1").drop("_nth")


def as_of(facts: DataFrame, versions: DataFrame, keys: list[str], at: str, since: str, values: list[str], forward: bool = False, smallest: bool | None = None) -> DataFrame:
    """``facts`` with ``values`` of the latest version that began by then, or of the next one to begin if ``forward``.

    Both sides meet in one shuffle by key and are read in order of time, so no fact meets all versions of its key. Of versions with one
    beginning the one with the ``smallest`` values counts, which is the rule forward; backward it is the largest. Backward takes a version
    that begins at the very moment; forward only later ones.
    """
    smallest = forward if smallest is None else smallest
    held = F.struct(*values)
    left = facts.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*facts.columns).alias("_fact"), F.lit(None).cast(versions.select(held).schema[0].dataType).alias("_held"))
    right = versions.select(*keys, F.col(since).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_fact"].dataType).alias("_fact"), held.alias("_held"))
    right = right.groupBy(*keys, "_at", "_side", "_fact").agg((F.min if smallest else F.max)("_held").alias("_held"))
    w = Window.partitionBy(*keys)
    if forward:
        w = w.orderBy("_at", "_side").rowsBetween(0, Window.unboundedFollowing)
        found = F.first("_held", ignorenulls=True).over(w)
    else:
        found = F.last("_held", ignorenulls=True).over(w.orderBy("_at", "_side"))
    return left.unionByName(right).withColumn("_found", found).filter("_fact IS NOT NULL").select("_fact.*", *[F.col(f"_found.{v}").alias(v) for v in values])


class _OpenSpans:
    """An entity's spans that may be open still, the last begun on top. Time goes forward, so one that has ended is never looked at again."""

    def __init__(self) -> None:
        self.entity, self.open = None, []

    def eval(self, row):
        if row["_entity"] != self.entity:
            self.entity, self.open = row["_entity"], []
        if row["_side"] == 0:
            self.open.append((row["_until"], row["_key"]))
            return
        while self.open and self.open[-1][0] is not None and self.open[-1][0] < row["_at"]:
            self.open.pop()
        if self.open:
            yield row["_fact"], self.open[-1][1]


def containing(facts: DataFrame, spans: DataFrame, entity: str, at: str, start: str, end: str, key: str, smallest: bool = False) -> DataFrame:
    """``facts`` with the key of the span of their entity that holds the moment; of several the one that began last, then the largest key, or the smallest.

    Facts of entities of up to SPANS_AT_ONCE spans look through the list of them. For others the span that
    began last is looked up, which mostly holds the moment. Where it has ended and one begun before lasts longer, those facts go through
    their entity's spans in order of time, with a stack of open ones. So no fact meets more spans than that.
    """
    return _by_spans(facts, spans, entity, lambda f, s: _containing_few(f, s, entity, at, start, end, key, smallest), lambda f, s: _containing_many(f, s, entity, at, start, end, key, smallest))


def _by_spans(facts: DataFrame, spans: DataFrame, entity: str, few: Callable[[DataFrame, DataFrame], DataFrame], many: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Facts of entities with many spans go one way, all others another; the results are the same either way."""
    hot = spans.groupBy(F.col(entity).alias("_hot")).agg(F.count("*").alias("_n")).filter(F.col("_n") > SPANS_AT_ONCE).select("_hot")
    if hot.isEmpty():
        return few(facts, spans)
    side = lambda rows, how: rows.join(hot, F.col(entity) == F.col("_hot"), how)
    return few(side(facts, "left_anti"), side(spans, "left_anti")).unionByName(many(side(facts, "left_semi"), side(spans, "left_semi")))


def _with_spans(facts: DataFrame, spans: DataFrame, entity: str, start: str, end: str, key: str, how: str) -> DataFrame:
    """``facts``, each a row still, with the list of their entity's spans (start, end, key): what is looked for in it takes no row for each pair, and no sort of such rows."""
    span = F.struct(F.col(start).alias("start"), F.col(end).alias("end"), F.col(key).alias("key"))
    return facts.join(spans.groupBy(entity).agg(F.collect_list(span).alias("_spans")), entity, how)


def _containing_few(facts: DataFrame, spans: DataFrame, entity: str, at: str, start: str, end: str, key: str, smallest: bool) -> DataFrame:
    t = F.col(at)
    holds = F.filter("_spans", lambda s: (s["start"] <= t) & (s["end"].isNull() | (s["end"] >= t)))
    last = F.array_max(F.transform(holds, lambda s: F.struct(s["start"].alias("start"), s["key"].alias("key"))))
    met = _with_spans(facts, spans, entity, start, end, key, "inner").select(*facts.columns, *(["_spans"] if smallest else []), last.alias("_last")).filter("_last IS NOT NULL")
    found = F.col("_last.key")
    if smallest:
        begun = F.filter("_spans", lambda s: (s["start"] == F.col("_last.start")) & (s["end"].isNull() | (s["end"] >= t)))
        found = F.array_min(F.transform(begun, lambda s: s["key"]))
    return met.select(*facts.columns, found.alias(key))


def _containing_many(facts: DataFrame, spans: DataFrame, entity: str, at: str, start: str, end: str, key: str, smallest: bool) -> DataFrame:
    own = spans.select(F.col(entity).alias("_entity"), F.col(start).alias("_start"), F.col(key).alias("_key"), F.col(end).alias("_until")).filter("_start IS NOT NULL AND _entity IS NOT NULL")
    begun = Window.partitionBy("_entity").orderBy("_start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    until = F.when(~F.bool_or(F.col("_until").isNull()).over(begun), F.max("_until").over(begun))  # null: one of those begun by then is open
    own = own.select("_entity", "_start", F.struct("_key", "_until", until.alias("_longest")).alias("_span"))
    rows = facts.select(F.col(entity).alias("_entity"), F.col(at).alias("_moment"), F.struct(*facts.columns).alias("_fact")).filter("_entity IS NOT NULL AND _moment IS NOT NULL")
    last = as_of(rows, own, ["_entity"], "_moment", "_start", ["_span"], smallest=smallest).filter("_span IS NOT NULL")
    holds = F.col("_span._until").isNull() | (F.col("_span._until") >= F.col("_moment"))
    found = last.filter(holds).select("_fact.*", F.col("_span._key").alias(key))
    older_may = F.col("_span._longest").isNull() | (F.col("_span._longest") >= F.col("_moment"))
    left = last.filter(~holds & older_may).select("_entity", F.col("_moment").cast("timestamp_ntz").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("timestamp_ntz").alias("_until"), F.lit(None).cast(spans.schema[key].dataType).alias("_key"), "_fact")
    older = own.join(left.select("_entity").distinct(), "_entity", "left_semi")
    older = older.select("_entity", F.col("_start").cast("timestamp_ntz").alias("_at"), F.lit(0).alias("_side"), F.col("_span._until").cast("timestamp_ntz").alias("_until"), F.col("_span._key").alias("_key"), F.lit(None).cast(left.schema["_fact"].dataType).alias("_fact"))
    kinds = f"_fact {left.schema['_fact'].dataType.simpleString()}, _key {spans.schema[key].dataType.simpleString()}"
    order = ["_at", "_side", F.desc("_key") if smallest else F.asc("_key")]
    stacked = F.udtf(_OpenSpans, returnType=kinds)(left.unionByName(older).asTable().partitionBy("_entity").orderBy(*order))
    return found.unionByName(stacked.select("_fact.*", F.col("_key").alias(key)))


def overlapping(spans: DataFrame, start: str, end: str, first: Column, last: Column, today: Column) -> DataFrame:
    """Spans that share a day with [first, last]; an open one lasts until today."""
    return spans.filter((F.col(start) <= last) & (F.coalesce(F.col(end), today) >= first))


def same_period(left: DataFrame, right: DataFrame, entity: str, start: str, end: str, key: str) -> DataFrame:
    """``left`` with the key of a span with the same start and end, open matching open; the smallest of several."""
    other = right.groupBy(F.col(entity).alias("_e"), F.col(start).alias("_s"), F.col(end).alias("_t")).agg(F.min(key).alias("match"))
    return left.join(other, (F.col(entity) == F.col("_e")) & (F.col(start) == F.col("_s")) & F.col(end).eqNullSafe(F.col("_t")), "left").drop("_e", "_s", "_t")


def by_code_and_band(rows: DataFrame, memberships: DataFrame) -> DataFrame:
    """Rows with code and band and their group: memberships hold for ``all`` bands or for one."""
    m = memberships.withColumnRenamed("code", "_code")
    return rows.join(m, (F.col("code") == F.col("_code")) & (F.col("selector").isin("all") | (F.col("selector") == F.col("band")))).drop("_code")


def resolved(facts: DataFrame, spans: DataFrame, entity: str, at: str, start: str, end: str, key: str, wanted: str | None = None) -> DataFrame:
    """``facts`` with the span each belongs to and the step that found it.

    Steps: 1 the wanted key; 2 the span that holds the moment and began last; 3 the nearest that began before; 4 the nearest that begins
    later; 5 the first key of those without a start; of several the smallest key. A fact without a span has neither key nor step. Entities of many spans are looked up step by step in order of time.
    """
    ways = [lambda f, s, way=way: way(f, s, entity, at, start, end, key, wanted) for way in (_resolved_few, _resolved_many)]
    return _by_spans(facts, spans, entity, *ways)


def _resolved_few(facts: DataFrame, spans: DataFrame, entity: str, at: str, start: str, end: str, key: str, wanted: str | None) -> DataFrame:
    """All steps are one look at the list of the entity's spans."""
    t = F.col(at)
    seconds = lambda c: F.unix_micros(c.cast("timestamp"))

    def found(s: Column) -> Column:
        began, ended = s["start"], s["end"]
        step = F.when(F.col(wanted) == s["key"], 1) if wanted else F.when(F.lit(False), 1)
        step = step.when((began <= t) & (ended.isNull() | (ended >= t)), 2).when(began <= t, 3).when(began > t, 4).otherwise(5)
        near = F.when(step.isin(2, 3), -seconds(began)).when(step == 4, seconds(began)).otherwise(0)
        return F.struct(step.alias("step"), near.alias("near"), s["key"].alias("key"))

    best = F.array_min(F.transform("_spans", found)).alias("_best")
    met = _with_spans(facts, spans.filter(F.col(key).isNotNull()), entity, start, end, key, "left")
    return met.select(*facts.columns, best).select(*facts.columns, F.col("_best.key").alias(key), F.col("_best.step").alias("step"))


def _resolved_many(facts: DataFrame, spans: DataFrame, entity: str, at: str, start: str, end: str, key: str, wanted: str | None) -> DataFrame:
    """Each step is a lookup of its own, in order of time, none of which meets all spans of an entity."""
    rows = facts.withColumn("_fact", F.struct(*facts.columns)).select(F.col(entity).alias("_entity"), F.col(at).alias("_moment"), *([F.col(wanted).alias("_wanted")] if wanted else []), "_fact")
    s = spans.filter(F.col(key).isNotNull()).select(F.col(entity).alias("_entity"), F.col(start).alias("_start"), F.col(end).alias("_end"), F.col(key).alias("_key"))
    begun = s.filter("_start IS NOT NULL")
    out = as_of(rows, begun, ["_entity"], "_moment", "_start", ["_key"], smallest=True).withColumnRenamed("_key", "_before")
    out = as_of(out, begun, ["_entity"], "_moment", "_start", ["_key"], forward=True).withColumnRenamed("_key", "_after")
    undated = s.filter("_start IS NULL").groupBy("_entity").agg(F.min("_key").alias("_undated"))
    out = out.join(undated, "_entity", "left")
    if wanted:
        named = s.select("_entity", F.col("_key").alias("_wanted"), F.lit(True).alias("_named")).distinct()
        out = out.join(named, ["_entity", "_wanted"], "left").withColumn("_first", F.when(F.col("_named"), F.col("_wanted")))
    else:
        out = out.withColumn("_first", F.lit(None).cast(spans.schema[key].dataType))
    moments = out.filter("_first IS NULL AND _before IS NOT NULL").select("_entity", "_moment").distinct()
    held = _containing_many(moments, begun, "_entity", "_moment", "_start", "_end", "_key", True).withColumnRenamed("_key", "_holds")
    out = out.join(held, ["_entity", "_moment"], "left")
    steps = ("_first", "_holds", "_before", "_after", "_undated")
    step = F.coalesce(*[F.when(F.col(c).isNotNull(), k) for k, c in enumerate(steps, 1)])
    return out.select("_fact.*", F.coalesce(*steps).alias(key), step.alias("step"))


def with_child_counts(parents: DataFrame, children: DataFrame, parent: str, child: str, grand: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    """Parents with their children: all, those that ``grand`` (child) names, and the rest. Each level is counted before it is joined."""
    busy = grand.select(child).distinct().withColumn("_busy", F.lit(1))
    counts = children.join(busy, child, "left").groupBy(parent).agg(F.count("*").alias("_n"), F.count("_busy").alias("_with"))
    n, some = F.coalesce("_n", F.lit(0)), F.coalesce("_with", F.lit(0))
    return parents.join(counts, parent, "left").select(*parents.columns, n.alias(names[0]), some.alias(names[1]), (n - some).alias(names[2]))


def reverse_mapped(rows: DataFrame, components: DataFrame) -> DataFrame:
    """Rows (code, band, name) with a group by (code, band), else by code alone, else by name for a blank code; unmatched rows go."""
    c = components
    exact = c.filter("band IS NOT NULL").select(F.col("code").alias("_c1"), F.col("band").alias("_b1"), F.col("group").alias("_g1"))
    plain = c.filter("band IS NULL AND code <> ''").select(F.col("code").alias("_c2"), F.col("group").alias("_g2"))
    named = c.filter("code = ''").select(F.col("name").alias("_n3"), F.col("group").alias("_g3"))
    out = rows.join(exact, (F.col("code") == F.col("_c1")) & (F.col("band") == F.col("_b1")), "left").join(plain, F.col("code") == F.col("_c2"), "left")
    out = out.join(named, (F.col("code") == "") & (F.col("name") == F.col("_n3")), "left")
    return out.withColumn("group", F.coalesce("_g1", "_g2", "_g3")).filter("group IS NOT NULL").select(*rows.columns, "group")
