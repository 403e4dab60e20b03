"""Queries on the driver's tables: each module has QUERIES and SQL, keyed by the same names."""

from importlib import import_module

#: Modules whose queries are registered.
MODULES = ("flows", "scalars", "lookups", "series", "metrics", "occupancy", "ledger", "planning", "scans", "filed", "catalogs")


def collected() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in MODULES:
        module = import_module(f"{__name__}.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
