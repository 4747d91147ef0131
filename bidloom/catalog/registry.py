"""Registry of named queries and of the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bidloom.catalog.roles_sql import compose

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is written independently of the DataFrame expression."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = compose(sql)
        return fn

    return add


def load() -> None:
    """Import every catalogue section once."""
    import importlib

    for section in SECTIONS:
        importlib.import_module(f"bidloom.catalog.{section}")


SECTIONS: list[str] = ["reports", "texts", "histories", "selections", "planning_scores", "models_streams"]
