"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame``
and, where the operation is expressible in SQL, the DuckDB oracle text
(tables are pre-registered views with the parquet table names)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import every query module so that they register themselves."""
    from msgscope.plans import (  # noqa: F401
        q_assembled,
        q_datasets,
        q_documents,
        q_eval,
        q_ml,
        q_sampling,
        q_service,
        q_silhouette,
        q_stats,
        q_store,
        q_stream,
        q_text,
        q_vectors,
    )
