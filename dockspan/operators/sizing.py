"""Size checks that decide between a broadcast and a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from dockspan.operators.joins import join_same

# Past either of these a broadcast competes with task memory.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 128 << 20
# Bytes of an array's or map's element, and of a fixed value with its share of the row.
ELEMENT, FIXED = 32, 8


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """True when ``df`` has at most ``max_rows`` rows and about ``max_bytes`` bytes.

    Strings and collections are measured; only they are read for it.
    """
    size = F.lit(FIXED * (len(df.columns) + 1))
    for field in df.schema.fields:
        value = F.col("`" + field.name.replace("`", "``") + "`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(value), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType)):
            size = size + F.greatest(F.coalesce(F.size(value), F.lit(0)), F.lit(0)) * ELEMENT
        elif isinstance(field.dataType, T.StructType):
            size = size + ELEMENT * len(field.dataType.fields)
    found = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return found["n"] <= max_rows and found["bytes"] <= max_bytes


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it is measured and found small, else as it is."""
    return F.broadcast(df) if fits_broadcast(df) else df


def attach(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join one lookup row per key onto many rows; a NULL key equals a NULL key.

    A lookup that is counted and found small is broadcast, so ``rows`` stays
    where it is however skewed its keys are. A larger one is shuffled, where
    adaptive execution splits the partitions of hot keys.
    """
    if fits_broadcast(lookup, max_rows):
        lookup = F.broadcast(lookup)
    return join_same(rows, lookup, keys, how)


def spread(scan: DataFrame) -> DataFrame:
    """Spread a table scan of few splits over all cores before heavy work.

    A table with at least one split per core is returned as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
