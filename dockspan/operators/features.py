"""Feature tables: filling, aligning, pruning, long and wide forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from dockspan.functions.columns import column


def fill_missing(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL and NaN become 0 in the named feature columns."""
    wanted = set(columns)
    return rows.select(
        [
            F.coalesce(F.nanvl(column(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c)
            if c in wanted
            else column(c)
            for c in rows.columns
        ]
    )


def align(
    rows: DataFrame,
    expected: Sequence[str] | None,
    keys: Sequence[str],
    drop: Sequence[str] = (),
) -> DataFrame:
    """``keys`` and then the expected columns in order; absent ones are 0.

    Columns that are not expected are dropped. Without an expectation the
    feature columns are taken in name order.
    """
    present = [c for c in rows.columns if c not in keys and c not in drop]
    wanted = sorted(present) if expected is None else [c for c in expected if c not in drop]
    have = set(present)
    return rows.select(
        *keys,
        *[column(c).cast("double").alias(c) if c in have else F.lit(0.0).alias(c) for c in wanted],
    )


def prune(rows: DataFrame, listed: Sequence[str], keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Keep listed features that exist, in list order; also return those missing."""
    have = set(rows.columns)
    kept = [c for c in listed if c in have]
    missing = [c for c in listed if c not in have]
    return rows.select(*keys, *[column(c) for c in kept]), missing


def to_long(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One ``(keys, feature, value)`` row per feature column."""
    return rows.unpivot(list(keys), [column(c) for c in columns], "feature", "value")


def to_wide(
    long: DataFrame, keys: Sequence[str], listed: Sequence[str], fill: float | None = 0.0
) -> DataFrame:
    """One row per key with the listed features as columns.

    Every key keeps its row, also one without any listed feature. Values of one
    feature are added up, whatever families give them; the pivot then places the
    sums by their feature's number, in one array per row.
    """
    rows = long.groupBy(*keys).pivot("feature", list(listed)).agg(F.sum("value"))
    value = [column(c) for c in listed]
    if fill is not None:
        value = [F.coalesce(v, F.lit(fill)) for v in value]
    return rows.select(*keys, *[v.alias(c) for v, c in zip(value, listed)])
