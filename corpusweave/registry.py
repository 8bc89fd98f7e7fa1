"""Collects the registered queries and their SQL from the query modules."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Registers ``fn(spark, sf_dir)`` under ``name`` with the SQL that must give the same rows."""

    def wrap(fn: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


def _load() -> None:
    from corpusweave import query_modules  # noqa: F401  registers on import


def queries() -> dict[str, Callable]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return ORACLES
