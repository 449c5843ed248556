"""Joins on keys that may be NULL."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def join_same(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL, as in a grouping; still an equi-join.

    The result has the left columns and, but for semi and anti joins, the right
    columns that are not keys.
    """
    renamed = right.select(
        *[F.col(c).alias(f"_on{i}") for i, c in enumerate(on)],
        *[F.col(c) for c in right.columns if c not in on],
    )
    same = [F.col(c).eqNullSafe(F.col(f"_on{i}")) for i, c in enumerate(on)]
    joined = left.join(renamed, reduce(lambda a, b: a & b, same, F.lit(True)), how)
    return joined.drop(*[f"_on{i}" for i in range(len(on))])
