"""Registry of the engine's queries: key → (Spark job over the driver tables, DuckDB oracle SQL).

Each submodule registers its keys on import. A key without SQL is checked by
row count only (iterative or model-backed jobs).
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def load_all() -> None:
    from caseflow.catalog import report, filters, search, text, coding, store, sources, vectors, streams  # noqa: F401


def queries() -> dict[str, Callable]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(ORACLE)
