"""One named query per operator, each with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


MODULES = ["names", "geometry", "compare", "arrays", "files", "joins", "aggregates", "ranking", "sets", "jobs", "streams"]


def load() -> None:
    for m in MODULES:
        import_module(f"quadlab.catalog.{m}")
