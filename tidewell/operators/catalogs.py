"""Catalog documents: every fault of a nested JSON document with its path, before anything of it is stored.

Documents are parsed as VARIANT, once each, and walked level by level within their row: the document, its groups, their codes. The faults of a
document are an array, so it shows all of them at once and nothing is shuffled. Rules that look across a document, such as keys that come twice,
go through its sorted keys or codes, in a time that hardly grows faster than the document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths, policies, selectors and versions.
LENGTHS = {"schema_version": 20, "source_reference": 255, "occupancy_algorithm_version": 30, "stable_key": 100, "display_name": 255, "source_code": 50, "configured_source_name": 255}
POLICIES, SELECTORS = ("standard", "linked_slots_pending", "unrated"), ("all", "under_12", "age_12_or_over")
LEGACY_SCHEMAS, SCHEMA = ("1.0", "1.1"), "2.0"
ALGORITHMS = ("occupancy-v1", "occupancy-v2", "occupancy-v3")
KEYS = {
    "document": ("schema_version", "source_reference", "occupancy_algorithm_version", "groups"),
    "group": ("stable_key", "display_name", "calculation_policy", "official_capacity", "source_codes"),
    "code": ("source_code", "configured_source_name", "age_selector"),
}


#: The faults of a node or document.
_FAULTS = "array<struct<path:string,fault:string>>"


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` worked out once however often it is used.

    Flatten and the like ask for the type of what they are given at every row, which walks all that it is made of; given this variable they don't.
    """
    return F.aggregate(F.array(), value, lambda so_far, _: so_far, use)


def _kind(value: Column) -> Column:
    """STRING, BIGINT, BOOLEAN and so on; VOID for null and for what isn't there."""
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _object(value: Column) -> Column:
    """The keys and values of an object, else null."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _items(value: Column) -> Column:
    """The items of a list, else null."""
    return F.try_variant_get(value, "$", "array<variant>")


def _text(node: Column, name: str) -> Column:
    """The value of a key that holds a text, else null."""
    return F.when(_kind(node[name]) == "STRING", F.try_variant_get(node[name], "$", "string"))


def _fault(path: Column, fault: Column | str) -> Column:
    return F.struct(path.alias("path"), (F.lit(fault) if isinstance(fault, str) else fault).alias("fault"))


def _said(path: Column, name: str, fault: Column) -> Column:
    """A fault of a key, null if there is none."""
    return _with(fault, lambda f: F.when(f.isNotNull(), _fault(F.concat(path, F.lit(f".{name}")), f)))


def _wants_text(node: Column, path: Column, name: str) -> Column:
    fault = _with(_text(node, name), lambda text: F.when(text.isNull() | text.rlike(r"^\s*$"), F.lit("missing")).when(F.length(text) > LENGTHS[name], F.lit("too_long")))
    return _said(path, name, fault)


def _wants_list(items: Column, path: Column, name: str) -> Column:
    return _said(path, name, F.when(F.coalesce(F.size(items), F.lit(0)) < 1, F.lit("missing")))


def _faults(*faults: Column) -> Column:
    return F.array_compact(F.array(*faults))


def _all(*lists: Column) -> Column:
    """The faults of several lists, of which any may be null."""
    return F.concat(*(F.coalesce(faults, F.array().cast(_FAULTS)) for faults in lists))


def _unknown_keys(node: Column, path: Column, level: str) -> Column:
    return F.transform(F.filter(F.map_keys(node), lambda key: ~key.isin(*KEYS[level])), lambda key: _fault(F.concat(path, F.lit("."), key), "unknown_key"))


def _of_objects(items: Column, path: Column, name: str, faults: Callable[[Column, Column], Column]) -> Column:
    """The faults of a list's items, and one for each item that is no object."""

    def of(item: Column, number: Column) -> Column:
        place = F.concat(path, F.lit(f".{name}["), number.cast("string"), F.lit("]"))
        return _with(place, lambda at: _with(_object(item), lambda node: F.when(node.isNull(), F.array(_fault(at, "not_an_object"))).otherwise(faults(node, at))))

    return _with(F.transform(items, of), F.flatten)


def _selector(code: Column) -> Column:
    return F.when(_kind(code["age_selector"]) == "VOID", "all").otherwise(_text(code, "age_selector"))


def _code_faults(code: Column, path: Column) -> Column:
    known = F.coalesce(_selector(code).isin(*SELECTORS), F.lit(False))
    texts = [_wants_text(code, path, name) for name in ("source_code", "configured_source_name")]
    return _all(_unknown_keys(code, path, "code"), _faults(*texts, _said(path, "age_selector", F.when(~known, F.lit("unsupported")))))


def _group_faults(group: Column, path: Column) -> Column:
    def of_capacity(policy: Column, kind: Column) -> Column:
        known = F.coalesce(policy.isin(*POLICIES), F.lit(False))
        amount = F.try_variant_get(group["official_capacity"], "$", "long")
        wrong = F.when(~kind.isin("VOID", "BIGINT"), "not_an_integer").when((kind == "BIGINT") & (amount <= 0), "not_positive")
        wrong = wrong.when((policy == "unrated") & (kind == "BIGINT"), "not_allowed").when(known & (policy != "unrated") & (kind == "VOID"), "missing")
        return _faults(_said(path, "calculation_policy", F.when(~known, F.lit("unsupported"))), _said(path, "official_capacity", wrong))

    texts = [_wants_text(group, path, name) for name in ("stable_key", "display_name")]
    ruled = _with(_text(group, "calculation_policy"), lambda policy: _with(_kind(group["official_capacity"]), lambda kind: of_capacity(policy, kind)))
    codes = _with(_items(group["source_codes"]), lambda items: _all(_faults(_wants_list(items, path, "source_codes")), _of_objects(items, path, "source_codes", _code_faults)))
    return _all(_unknown_keys(group, path, "group"), _faults(*texts), ruled, codes)


def _repeated_keys(groups: Column, path: Column) -> Column:
    """A fault for each group with the key of an earlier one."""

    def keyed(item: Column, g: Column) -> Column:
        return F.struct(F.trim(_text(_object(item), "stable_key")).alias("key"), g.alias("g"))

    def of(keys: Column) -> Column:
        again = F.filter(keys, lambda key, k: F.coalesce(F.get(keys, k - 1)["key"] == key["key"], F.lit(False)))
        return F.transform(again, lambda key: _fault(F.concat(path, F.lit(".groups["), key["g"].cast("string"), F.lit("].stable_key")), "repeated"))

    keys = _with(F.transform(groups, keyed), lambda keys: F.sort_array(F.filter(keys, lambda key: key["key"] != "")))
    return _with(keys, of)


def _partition_faults(groups: Column, path: Column) -> Column:
    """A fault for each source code that is neither whole in one place nor split into two bands in two groups, at its first place."""

    def used(item: Column, g: Column) -> Column:
        def of(code: Column, c: Column) -> Column:
            place = F.concat(path, F.lit(".groups["), g.cast("string"), F.lit("].source_codes["), c.cast("string"), F.lit("]"))
            return _with(_object(code), lambda node: F.struct(F.trim(_text(node, "source_code")).alias("code"), g.alias("g"), place.alias("path"), _selector(node).alias("selector")))

        return F.filter(F.transform(_items(_object(item)["source_codes"]), of), lambda use: use["code"] != "")

    def of_uses(uses: Column) -> Column:
        """The uses lie sorted, so those of one code are a run."""
        first = F.transform(uses, lambda use, k: F.when(F.coalesce(F.get(uses, k - 1)["code"] != use["code"], F.lit(True)), k))
        return _with(F.array_compact(first), lambda starts: F.transform(starts, lambda start, k: of_run(F.slice(uses, start + 1, F.coalesce(F.get(starts, k + 1), F.size(uses)) - start))))

    def of_run(run: Column) -> Column:
        def of(uses: Column) -> Column:
            one, two = F.get(uses, 0), F.get(uses, 1)
            whole = F.exists(uses, lambda use: F.coalesce(use["selector"] == "all", F.lit(False)))
            split = (F.size(uses) == 2) & F.coalesce(one["selector"] != two["selector"], F.lit(False))
            fault = F.when(whole, F.when(F.size(uses) > 1, "all_with_another")).when(~split, "incomplete_partition").when(one["g"] == two["g"], "partition_in_one_group")
            return _with(fault, lambda f: F.when(f.isNotNull(), _fault(one["path"], f)))

        return _with(run, of)

    uses = _with(F.transform(groups, used), lambda lists: F.sort_array(F.flatten(F.array_compact(lists))))
    return F.array_compact(_with(uses, of_uses))


def _document_faults(document: Column, path: Column) -> Column:
    def of_versions(schema: Column, algorithm: Column) -> Column:
        given = _kind(document["occupancy_algorithm_version"]) != "VOID"
        wrong_algorithm = F.when(schema == SCHEMA, F.when(algorithm.isNull() | (algorithm == ""), "missing").when(F.length(algorithm) > LENGTHS["occupancy_algorithm_version"], "too_long").when(~algorithm.isin(*ALGORITHMS), "unsupported"))
        wrong_algorithm = F.coalesce(wrong_algorithm, F.when(schema.isin(*LEGACY_SCHEMAS) & given, F.lit("not_allowed")))
        wrong_schema = F.when((schema != "") & (F.length(schema) <= LENGTHS["schema_version"]) & ~schema.isin(SCHEMA, *LEGACY_SCHEMAS), F.lit("unsupported"))
        return _faults(_wants_text(document, path, "schema_version"), _said(path, "schema_version", wrong_schema), _said(path, "occupancy_algorithm_version", wrong_algorithm))

    versions = _with(F.trim(_text(document, "schema_version")), lambda schema: _with(F.trim(_text(document, "occupancy_algorithm_version")), lambda algorithm: of_versions(schema, algorithm)))

    def of_groups(groups: Column) -> Column:
        return _all(_faults(_wants_list(groups, path, "groups")), _of_objects(groups, path, "groups", _group_faults), _repeated_keys(groups, path), _partition_faults(groups, path))

    return _all(_unknown_keys(document, path, "document"), versions, _faults(_wants_text(document, path, "source_reference")), _with(_items(document["groups"]), of_groups))


def _found(document: Column, effective_from: Column, today: Column) -> Column:
    """All faults of a document and of the date from which it is to hold; an empty array if it has none."""
    path = F.lit("$")

    def of_node(node: Column) -> Column:
        walked = _with(_object(node), lambda keys: F.when(keys.isNull(), F.array(_fault(path, "not_an_object"))).otherwise(_document_faults(keys, path)))
        return F.when(node.isNull(), F.array(_fault(path, "not_json"))).otherwise(walked)

    def of_day(text: Column) -> Column:
        day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))
        return _with(F.when(day.isNull(), "not_a_date").when(day <= today, "not_later"), lambda late: F.when(late.isNotNull(), _fault(F.lit("effective_from"), late)))

    return _all(_faults(_with(effective_from, of_day)), _with(F.try_parse_json(document), of_node)).cast(_FAULTS)


def catalog_faults(documents: DataFrame, today: Column) -> DataFrame:
    """id, path, fault of every fault in ``documents`` (id, document, effective_from as texts). A document without one may be stored.

    ``missing`` is a key that isn't there, has another type or is blank; a list without items is missing as well. ``today`` is a date
    that effective_from must lie after. A null document is no JSON. Rules on a policy's capacity and on a schema's algorithm are
    looked at where the policy or schema is a known one. Each row is a document of its own, even if ids repeat.
    """
    return documents.select("id", F.explode(_found(F.col("document"), F.col("effective_from"), today)).alias("f")).select("id", "f.path", "f.fault")


def valid_catalogs(documents: DataFrame, today: Column) -> DataFrame:
    """The documents in which ``catalog_faults`` finds nothing, with the SHA-256 of the very text."""
    faultless = F.size(_found(F.col("document"), F.col("effective_from"), today)) == 0
    return documents.select("*", F.explode(F.when(faultless, F.array(F.sha2("document", 256)))).alias("sha256"))  # a filter would run before a shuffle that deals the documents
