"""Registry of named queries: ``key -> (spark_fn(spark, sf_dir) -> DataFrame, oracle SQL or None)``.

Modules under ``tiergate.queries_*`` register themselves on import; ``__spark_entry__`` only reads this table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | Callable[[], str] | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql() if callable(sql) else sql
        return fn

    return deco


def load_all() -> None:
    from . import catalog  # noqa: F401  (registers every query)
