"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its check on the same tables."""

    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def rounded(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """Round double columns, the way the checks do, and keep the column order."""
    wanted = set(columns if columns is not None else [c for c, t in df.dtypes if t == "double"])
    return df.select([F.round(c, digits).alias(c) if c in wanted else F.col(c) for c in df.columns])


def r6(column: Column) -> Column:
    return F.round(column, 6)
