"""Registered queries: every operator on the driver tables, with its SQL counterpart where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function name, with the SQL that must give the same rows."""

    def register(fn: Query) -> Query:
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return register


def load_all() -> None:
    from . import (  # noqa: F401
        aggregates,
        chains,
        cleaning,
        contracts,
        joining,
        models,
        ordering,
        panels,
        quality,
        reports,
        resampling,
        scalars,
        scoring,
        series,
        sources,
        statistics,
        windows,
    )
