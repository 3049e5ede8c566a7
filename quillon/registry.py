"""Name -> (query, SQL twin), filled by the query modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None) -> None:
    assert name not in _QUERIES, name
    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = sql


def _load() -> None:
    for module in ("tpch", "relational", "scalar", "streams"):
        importlib.import_module(f"quillon.suite.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
