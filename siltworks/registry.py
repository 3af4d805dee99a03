"""Where the queries of the engine are registered, and how they read their tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltworks.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its DuckDB SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lit(x: str) -> str:
    """A string literal of DuckDB's dialect."""
    return "'" + x.replace("'", "''") + "'"


def spark_lit(x: str) -> str:
    """A string literal of Spark's dialect."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
