"""Small constant tables without a data source."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession


def _sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else repr(value)


def literal_table(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """A table of literals, which the optimizer knows the size of."""
    fields = [part.split() for part in schema.split(",")]
    values = ", ".join("(" + ", ".join(map(_sql_literal, row)) + ")" for row in rows)
    casts = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in fields)
    names = ", ".join(name for name, _ in fields)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({names})")
