"""Registry of queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seamark.plans.bindings import SQL_TABLES, Tables
from seamark.session import ship_package

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``. ``sql`` may use the bound tables as CTEs and may start with
    its own WITH clause."""
    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_tables(sql)
        return fn
    return wrap


def with_tables(sql: str) -> str:
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH RECURSIVE {SQL_TABLES},\n{body[5:]}"
    return f"WITH RECURSIVE {SQL_TABLES}\n{body}"
