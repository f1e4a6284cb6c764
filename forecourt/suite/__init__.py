"""Registered queries over the test tables, each with the SQL it must agree with."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = ["counts", "sales", "charts", "chats", "listings", "scalars", "files", "streams"]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        if name in _queries:
            raise ValueError(f"query {name} is registered twice")
        _queries[name] = function
        if sql is not None:
            _sql[name] = sql
        return function

    return register


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"forecourt.suite.{module}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def all_sql(sf_dir: str) -> dict[str, str]:
    """The SQL of the queries, for tables that lie in ``sf_dir``."""
    _load()
    return {name: sql.replace("{sf_dir}", sf_dir) for name, sql in _sql.items()}
