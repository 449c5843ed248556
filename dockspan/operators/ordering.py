"""Ranks, running sums and neighbour rows for groups of any size.

A plain window sends each group to one task. That is right for small groups
and fails when one group holds a large share of the table, so these functions
look at the largest group first and spread big groups over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from dockspan.operators.durable import durable
from dockspan.operators.joins import join_same

# A window over this many narrow rows sorts within one task's memory.
WINDOW_ROWS = 2_000_000
BLOCK_ROWS = 65_536


def largest_group(df: DataFrame, group: Sequence[str]) -> int:
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column] | None = None,
    position: str | None = None,
    max_group_rows: int = WINDOW_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Add a 1-based ``position`` and inclusive running ``sums`` in ``order``.

    ``order`` must be total within a group. Groups above ``max_group_rows``
    are range-partitioned on ``(group, order)``: every slice is scanned on its
    own and starts from the total of the slices before it. ``largest`` saves
    counting the groups when an upper bound of their size is known.
    """
    sums = dict(sums or {})
    if group and largest is None:
        largest = largest_group(df, group)
    if group and largest <= max_group_rows:
        ordered = Window.partitionBy(*group).orderBy(*order)
        to_here = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        added = [F.sum(c).over(to_here).alias(n) for n, c in sums.items()]
        if position:
            added.append(F.row_number().over(ordered).cast("bigint").alias(position))
        return df.select("*", *added)
    return _running_in_slices(df, group, order, sums, position)


def _running_in_slices(df, group, order, sums, position):
    # The stored slices fix which rows each one holds, so the totals below and
    # the rows they are added to agree even if a task is run again.
    keys = [F.col(c) for c in group]
    sliced = durable(
        df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id())
    )
    parts = {f"_sum{i}": c for i, c in enumerate(sums.values())}
    totals = sliced.groupBy(*group, "_slice").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(n) for n, c in parts.items()]
    )
    by_group = Window.partitionBy(*group).orderBy("_slice")
    earlier = by_group.rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col("_slice").alias("_at"),
        *[F.col(c).alias(f"_key{i}") for i, c in enumerate(group)],
        F.sum("_rows").over(earlier).alias("_before"),
        *[F.sum(n).over(earlier).alias(f"{n}_before") for n in parts],
    ).filter("_before is not null")
    # A slice continues at most one group begun in an earlier slice: `starts`
    # has no more rows than there are slices.
    same = [F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(group)]
    on = reduce(lambda a, b: a & b, same, F.col("_slice") == F.col("_at"))
    local = Window.partitionBy(*group, "_slice").orderBy(*order)
    to_here = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = sliced.select(
        "*",
        F.row_number().over(local).cast("bigint").alias("_row"),
        *[F.sum(c).over(to_here).alias(f"{n}_here") for n, c in parts.items()],
    ).join(F.broadcast(starts), on, "left")
    added = [
        (F.col(f"{n}_here") + F.coalesce(F.col(f"{n}_before"), F.lit(0))).alias(name)
        for n, name in zip(parts, sums)
    ]
    if position:
        added.append((F.col("_row") + F.coalesce("_before", F.lit(0))).alias(position))
    return scanned.select(*df.columns, *added)


def ranked(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    name: str = "rank",
    max_group_rows: int = WINDOW_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Number the rows of each group from 1 in ``order``."""
    return running(
        df, group, order, position=name, max_group_rows=max_group_rows, largest=largest
    )


def with_neighbours(
    df: DataFrame,
    group: Sequence[str],
    position: str,
    reach: int,
    columns: Callable[[WindowSpec], Mapping[str, Column]],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add columns that look at most ``reach`` rows back or ahead.

    ``position`` numbers the rows of a group densely. Rows are windowed in
    blocks of positions, each with a margin of ``reach`` copied rows on both
    ends, so no task needs more than one block of a group.
    """
    own = F.floor(F.col(position) / block_rows)
    seen_from = F.array_distinct(
        F.array(
            F.floor((F.col(position) - reach) / block_rows),
            own,
            F.floor((F.col(position) + reach) / block_rows),
        )
    )
    blocks = df.withColumn("_block", F.explode(seen_from))
    window = Window.partitionBy(*group, "_block").orderBy(position)
    added = [c.alias(n) for n, c in columns(window).items()]
    return blocks.select("*", *added).filter(F.col("_block") == own).drop("_block")


def running_by_position(
    df: DataFrame,
    group: Sequence[str],
    position: str,
    value: Column,
    name: str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Running sum of ``value`` where rows already carry a dense ``position``.

    Rows with a NULL group key form a group of their own, as in a window.
    """
    blocks = df.withColumn("_block", F.floor(F.col(position) / block_rows)).withColumn(
        "_value", value
    )
    window = Window.partitionBy(*group, "_block").orderBy(position)
    totals = blocks.groupBy(*group, "_block").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = totals.select(
        *group, "_block", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before")
    )
    to_here = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = blocks.withColumn("_here", F.sum("_value").over(to_here))
    return join_same(here, starts, [*group, "_block"]).select(
        *df.columns, (F.col("_here") + F.col("_before")).alias(name)
    )
