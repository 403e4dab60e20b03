"""Nested records: JSON with aliases, extra keys, contracts, ordered labels, and lines of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TEXT_MAP = "map<string,string>"


def fields(json: Column) -> Column:
    """A JSON object's fields as a map of texts; null if it isn't one."""
    return F.from_json(json, _TEXT_MAP)


def merged_fields(json: Column, extra: Column) -> Column:
    """Both objects' fields; the second one's win."""
    a, b = (F.coalesce(fields(c), F.create_map().cast(_TEXT_MAP)) for c in (json, extra))
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def by_alias(record: Column, *aliases: str) -> Column:
    """The first alias that is filled; then the first key that equals an alias but for case and blanks."""
    loose = F.array_sort(F.map_entries(record))
    found = [F.nullif(record[a], F.lit("")) for a in aliases]
    for a in aliases:
        found.append(F.nullif(F.get(F.filter(loose, _spelled(a)), F.lit(0))["value"], F.lit("")))
    return F.coalesce(*found)


def _spelled(alias: str):
    return lambda entry: F.lower(F.replace(entry["key"], F.lit(" "), F.lit(""))) == alias.replace(" ", "").lower()


def extra_fields(record: Column, *known: str) -> Column:
    """Filled fields besides the known ones."""
    return F.map_filter(record, lambda k, v: ~k.isin(*known) & (F.coalesce(v, F.lit("")) != ""))


def without_key(record: Column, key: str) -> Column:
    return F.map_filter(record, lambda k, v: k != key)


def contract_errors(record: Column, required: dict[str, str]) -> Column:
    """What a record lacks: ``missing:<key>`` or ``pattern:<key>``, in the order of ``required`` (key: regular expression)."""
    checks = []
    for key, pattern in required.items():
        checks.append(F.when(F.coalesce(record[key], F.lit("")) == "", F.lit(f"missing:{key}")).when(~record[key].rlike(pattern), F.lit(f"pattern:{key}")))
    return F.array_compact(F.array(*checks))


def ordered_labels(labels: Column) -> Column:
    """Each label once, where it first occurs, trimmed; blank ones go."""
    return F.array_distinct(F.filter(F.transform(labels, lambda x: F.trim(x)), lambda x: x != ""))


def report_lines(reports: DataFrame, key: str, text: str) -> DataFrame:
    """key, position, line of every line; form feeds and outer blanks go."""
    lines = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\f\r]", ""), "\n")
    return reports.select(key, F.posexplode(lines).alias("position", "line")).withColumn("line", F.trim("line"))


def without_artifacts(lines: DataFrame, key: str, artifact: str) -> DataFrame:
    """Lines that don't match the pattern of page artifacts; of blank lines in a row one stays."""
    kept = lines.filter(~F.col("line").rlike(artifact))
    before = F.lag("line").over(Window.partitionBy(key).orderBy("position"))
    return kept.withColumn("_before", before).filter(~((F.col("line") == "") & (F.coalesce("_before", F.lit("")) == ""))).drop("_before")


def report_events(lines: DataFrame, key: str, opens: str, closes: str) -> DataFrame:
    """key, event, first, last, content, closed: runs of lines from one that matches ``opens`` to the next.

    What follows the line that matches ``closes`` is no part of the event; without one, closed is false. Lines before the first event go.
    The window has a report's lines only.
    """
    w = Window.partitionBy(key).orderBy("position")
    event = F.sum(F.col("line").rlike(opens).cast("int")).over(w)
    numbered = lines.withColumn("event", event).filter("event > 0")
    within = Window.partitionBy(key, "event").orderBy("position")
    ended = F.sum(F.col("line").rlike(closes).cast("int")).over(within.rowsBetween(Window.unboundedPreceding, -1))
    body = numbered.withColumn("_ended", F.coalesce(ended, F.lit(0))).filter("_ended = 0")
    parts = F.array_sort(F.collect_list(F.struct("position", "line")))
    out = body.groupBy(key, "event").agg(parts.alias("_parts"), F.bool_or(F.col("line").rlike(closes)).alias("closed"))
    content = F.array_join(F.transform("_parts", lambda p: p["line"]), "\n")
    return out.select(key, "event", F.col("_parts")[0]["position"].alias("first"), F.element_at("_parts", -1)["position"].alias("last"), content.alias("content"), "closed")


def signature_author(line: Column) -> Column:
    """What stands between ``por`` and ``em`` with a date; blank otherwise."""
    found = F.regexp_extract(line, r"(?i)\bpor[:\s]+(.+?)\s+em:?\s*[0-9]{2}/[0-9]{2}/[0-9]{4}", 1)
    return F.trim(F.regexp_replace(found, r"^[ ,\-:]+|[ ,\-:]+$", ""))


def signature_time(line: Column) -> Column:
    """The date and time behind ``em``; noon where there is only a date; null for neither."""
    day = F.regexp_extract(line, r"(?i)\bem:?\s*([0-9]{2}/[0-9]{2}/[0-9]{4})", 1)
    clock = F.regexp_extract(line, r"(?i)\bem:?\s*[0-9]{2}/[0-9]{2}/[0-9]{4}[ ,]+(?:às )?([0-9]{2}:[0-9]{2})(?::([0-9]{2}))?", 1)
    seconds = F.regexp_extract(line, r"(?i)\bem:?\s*[0-9]{2}/[0-9]{2}/[0-9]{4}[ ,]+(?:às )?[0-9]{2}:[0-9]{2}:([0-9]{2})", 1)
    clock = F.when(clock == "", "12:00").otherwise(clock)
    return F.try_to_timestamp(F.concat(day, F.lit(" "), clock, F.lit(":"), F.when(seconds == "", "00").otherwise(seconds)), F.lit("dd/MM/yyyy HH:mm:ss"))
