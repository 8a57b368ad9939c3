"""The queries of the library, by name, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame."""

    def add(f):
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


def queries() -> dict[str, Callable]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
