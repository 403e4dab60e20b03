"""How the query modules register a query with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from tidewell.session import table


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def register(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return register


class Binding:
    """Columns of a test table under the names that an operator expects, in expressions that both engines read."""

    def __init__(self, source: str, *columns: str, where: str = ""):
        self.source, self.columns, self.where = source, columns, where

    @property
    def sql(self) -> str:
        return f"SELECT {', '.join(self.columns)} FROM {self.source}" + (f" WHERE {self.where}" if self.where else "")

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, self.source)
        rows = rows.filter(self.where) if self.where else rows
        return rows.selectExpr(*self.columns)


def case(value: str, choices: Sequence[str], otherwise: str = "''") -> str:
    """``choices[value]`` as CASE, for bindings."""
    whens = " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(choices))
    return f"CASE {value} {whens} ELSE {otherwise} END"
