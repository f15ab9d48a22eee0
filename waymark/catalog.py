"""Queries of the engine's operators over the driver's tables, each beside its DuckDB twin.

``QUERIES`` maps a name to a function of (spark, sf_dir); ``ORACLES`` to SQL with the same column names. A query without SQL is
one that SQL can't express; its test holds it against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables by name, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a function of :class:`Tables` under its own name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def load() -> None:
    """Import the modules that register queries."""
    from waymark import queries_joins, queries_places, queries_shapes, queries_tables, queries_text  # noqa: F401
