"""Registered queries: each operator on the test tables, with the same result in DuckDB's SQL where that can say it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


from . import legacy, metrics, pairs, pose, runs, streams  # noqa: E402, F401
