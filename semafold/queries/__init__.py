"""Registered queries, each over its whole tables, beside the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable


def registered() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    """(queries, sql, decorator): @query(sql) registers a function under its own name."""
    queries: dict[str, Callable] = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            name = f.__name__.rstrip("_")
            queries[name] = f
            if text:
                sql[name] = text
            return f

        return add

    return queries, sql, query
