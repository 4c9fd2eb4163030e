"""Named queries and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir); sql is DuckDB's text with the same columns and rows."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def r6(x: Column | str, name: str) -> Column:
    """Rounded as in the SQL, since sums of doubles depend on the order; no negative zero."""
    return (F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)).alias(name)


def _load() -> None:
    from . import aggregate_queries, cluster_queries, ledger_queries, model_queries, more_queries, page_queries, range_queries, routing_queries, scalar_queries, series_queries, text_queries, workbook_queries  # noqa: F401


_load()
