"""Registry of runnable queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.plans.tables import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, tables: str = "", sql: str | None = None, recursive: bool = False):
    """Register ``fn(tables) -> DataFrame`` under ``name``, with an oracle if ``sql`` is given."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(tables, sql, recursive)
        return fn

    return wrap
