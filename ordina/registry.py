"""All queries by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir); `sql` is its oracle, if SQL can express it."""

    def put(function: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return put


def queries() -> dict[str, Callable]:
    from . import catalog  # noqa: F401  registers every query

    return QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return SQL
