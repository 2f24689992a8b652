"""Every registered query with the DuckDB SQL that states the same result."""

from __future__ import annotations

from semafold.queries import collections, finds, joins, operators, pipelines, sources, strings

MODULES = [finds, operators, strings, collections, joins, sources, pipelines]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
