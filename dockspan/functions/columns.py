"""Column references."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def present(value: Column) -> Column:
    """The value, or NULL where it is missing: NULL or NaN."""
    return F.nullif(value, F.lit(float("nan")).cast("double"))


def column(name: str) -> Column:
    """The column of exactly this name; feature names may hold dots and spaces."""
    return F.col("`" + name.replace("`", "``") + "`")
