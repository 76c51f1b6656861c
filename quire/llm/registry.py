"""Queries of the training-data operators: (spark, sf_dir) -> DataFrame, and
DuckDB SQL where SQL expresses the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import quire.llm.queries  # noqa: F401
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    import quire.llm.queries  # noqa: F401
    return dict(ORACLE)
