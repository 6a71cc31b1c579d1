"""Registry behind ``queries()`` and ``oracle_sql()``."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pairlab.session import ensure_importable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, Callable[[], str]] = {}


def query(name: str, sql: Callable[[], str] | str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame and, optionally, its DuckDB oracle."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark, sf_dir):
            ensure_importable(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql if callable(sql) else (lambda s=sql: s)
        return fn
    return deco
