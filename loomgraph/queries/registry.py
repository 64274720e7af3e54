"""Names of queries, what runs them, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of a session and a folder of tables under ``name``, with SQL for the same rows."""

    def add(run: Callable) -> Callable:
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return add
