"""Registry of named queries: a Spark builder and (when SQL can express it)
an equivalent DuckDB-runnable SQL text over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from lotline.plans import (  # noqa: F401
        asof_queries,
        clean_queries,
        derive_queries,
        join_queries,
        spatial_queries,
        trend_queries,
        stats_queries,
        ranking_queries,
        score_queries,
        usage_queries,
        source_queries,
        spine_queries,
        model_queries,
    )
