"""Query registry: name -> (Spark query, reference SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glossloom.session import checkpoint

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_SHARED: dict[tuple[str, str, str], DataFrame] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def shared(spark: SparkSession, sf_dir: str, name: str, build: Query) -> DataFrame:
    """A table that several queries of a session use, written once to the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _SHARED:
        _SHARED[key] = checkpoint(build(spark, sf_dir))
    return _SHARED[key]
