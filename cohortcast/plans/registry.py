"""Query registry: every implemented operator as (Spark builder, DuckDB oracle SQL).

Each builder takes (spark, sf_dir) and returns a DataFrame over the whole fixture
tables; the oracle SQL (when the operator is SQL-expressible) computes the same
result from the base tables.  Double columns are rounded identically on both
sides (see ``finalize``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .finalize import DEFAULT_DIGITS, finalize, sql_round

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    build: Builder
    sql: str | Callable[[], str] | None = None  # built when asked for, where views of other modules take part
    doubles: list[str] = field(default_factory=list)
    digits: int = DEFAULT_DIGITS
    overrides: dict[str, int] = field(default_factory=dict)
    ops: str = ""
    sql_rounded: bool = False  # the SQL already rounds its double columns (data-dependent column sets)

    def spark_df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return finalize(self.build(spark, sf_dir), self.digits, self.overrides)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        sql = self.sql() if callable(self.sql) else self.sql
        if self.sql_rounded:
            return sql
        return sql_round(sql, self.doubles, self.digits, self.overrides)


REGISTRY: dict[str, Query] = {}


def register(name: str, ops: str = "", sql: str | Callable[[], str] | None = None, doubles: list[str] | None = None,
             digits: int = DEFAULT_DIGITS, overrides: dict[str, int] | None = None, sql_rounded: bool = False):
    def deco(fn: Builder) -> Builder:
        REGISTRY[name] = Query(name, fn, sql, list(doubles or []), digits, dict(overrides or {}), ops, sql_rounded)
        return fn

    return deco


def all_queries() -> dict[str, Query]:
    # importing the query modules fills REGISTRY
    from . import (  # noqa: F401
        q_comparators,
        q_config,
        q_diagnostics,
        q_draws,
        q_loo,
        q_prep,
        q_reports,
        q_scoring,
        q_sources,
    )

    return REGISTRY
