"""Named queries: a DataFrame builder over a table folder, and equivalent SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rnd(c: str | Column, digits: int = 6) -> Column:
    """Rounded double without negative zero, to compare engines."""
    r = F.round(F.col(c) if isinstance(c, str) else c, digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def srnd(expr: str, digits: int = 6) -> str:
    return f"CASE WHEN round({expr}, {digits}) = 0 THEN 0.0::DOUBLE ELSE round({expr}, {digits}) END"
