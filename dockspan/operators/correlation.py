"""Pearson, Spearman and Kendall correlation per group."""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from dockspan.functions.columns import present
from dockspan.operators.durable import durable
from dockspan.operators.joins import join_same
from dockspan.operators.ordering import WINDOW_ROWS, largest_group, ranked

# Rows whose order one task compares directly.
BLOCK_ROWS = 65_536


def complete_pairs(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Rows that have both values; NULL and NaN are missing alike."""
    return rows.filter(present(F.col(x).cast("double")).isNotNull() & present(F.col(y).cast("double")).isNotNull())


def with_mid_rank(
    rows: DataFrame,
    group: Sequence[str],
    value: str,
    name: str,
    max_group_rows: int = WINDOW_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Ascending rank where equal values share the mean of their places.

    Small groups take plain windows. Otherwise rows are dealt by range of
    ``(group, value)`` and row number, so that a very frequent value spreads over many
    slices too; a slice ranks its own rows, and runs of equal values that go on
    over its border get their places from a table of at most two runs a slice.
    """
    if largest is None:
        largest = largest_group(rows, group)
    if group and largest <= max_group_rows:
        before = F.rank().over(Window.partitionBy(*group).orderBy(value))
        same = F.count(F.lit(1)).over(Window.partitionBy(*group, value))
        return rows.withColumn(name, before + (same - 1) / 2.0)
    keys = [F.col(c) for c in group]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id())
    sliced = durable(
        dealt.repartitionByRange(*keys, F.col(value), F.col("_row")).drop("_row").withColumn("_slice", F.spark_partition_id())
    )
    parts = sliced.groupBy(*group, "_slice").agg(
        F.count(F.lit(1)).alias("_rows"), F.min(value).alias("_low"), F.max(value).alias("_high")
    )
    by_slice = Window.partitionBy(*group).orderBy("_slice")
    parts = parts.select(
        "*",
        F.coalesce(F.sum("_rows").over(by_slice.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.count(F.lit(1)).over(Window.partitionBy(*group)).alias("_slices"),
    )
    # Groups of several slices have at most two parts a slice.
    parts = durable(parts.filter("_slices > 1").drop("_slices"))
    at_borders = join_same(sliced.select(*group, "_slice", value), F.broadcast(parts), [*group, "_slice"]).filter(
        (F.col(value) == F.col("_low")) | (F.col(value) == F.col("_high"))
    )
    runs = at_borders.groupBy(*group, value, "_slice").agg(
        F.count(F.lit(1)).alias("_n"),
        F.first(F.col("_before") + F.when(F.col(value) == F.col("_low"), 0)).alias("_first"),
        F.first(F.col("_before") + F.col("_rows")).alias("_end"),
    )
    # Only the first of several slices can have other values before the run.
    first = F.min(F.coalesce("_first", F.col("_end") - F.col("_n")))
    joined = runs.groupBy(*group, value).agg(
        F.count(F.lit(1)).alias("_parts"), (first + (F.sum("_n") + 1) / 2.0).alias("_mean")
    )
    joined = durable(joined.filter("_parts > 1").drop("_parts"))
    local = Window.partitionBy(*group, "_slice")
    places = F.rank().over(local.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*group, "_slice", value)) - 1) / 2.0
    placed = join_same(
        sliced.withColumn("_place", places), F.broadcast(parts.select(*group, "_slice", "_before")), [*group, "_slice"], "left"
    )
    placed = join_same(placed, F.broadcast(joined), [*group, value], "left")
    mean = F.coalesce("_mean", F.col("_place") + F.coalesce("_before", F.lit(0)))
    return placed.select(*rows.columns, mean.alias(name))


def linear_correlations(
    rows: DataFrame,
    group: Sequence[str],
    x: str,
    y: str,
    max_group_rows: int = WINDOW_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Pearson on the values and Spearman on their mid-ranks; incomplete pairs are left out."""
    limits = {"max_group_rows": max_group_rows, "largest": largest}
    narrow = complete_pairs(rows.select(*group, x, y), x, y)
    if largest is None:
        limits["largest"] = largest_group(narrow, group)
    placed = with_mid_rank(narrow, group, x, "_rank_x", **limits)
    placed = with_mid_rank(placed, group, y, "_rank_y", **limits)
    return placed.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.corr(x, y).alias("pearson"),
        F.corr("_rank_x", "_rank_y").alias("spearman"),
    )


def _tied_pairs(rows: DataFrame, group: Sequence[str], values: Sequence[str], name: str):
    runs = rows.groupBy(*group, *values).agg(F.count(F.lit(1)).alias("_n"))
    return runs.groupBy(*group).agg(
        F.sum(F.expr("(_n * (_n - 1)) div 2")).alias(name), F.sum("_n").alias(f"{name}_rows")
    )


def count_inversions(order: np.ndarray) -> int:
    """Pairs out of order in a sequence of distinct integers.

    Splits by one bit of the rank at a time, highest first: within rows that
    agree on the higher bits, each 0 bit is inverted with every 1 before it.
    """
    rank = np.empty(len(order), dtype=np.int64)
    rank[np.argsort(order)] = np.arange(len(order))
    total = 0
    for bit in range(max(len(order) - 1, 0).bit_length() - 1, -1, -1):
        high = rank >> (bit + 1)
        one = (rank >> bit) & 1
        ones_before = np.cumsum(one) - one
        first_of_run = np.r_[True, high[1:] != high[:-1]]
        base = ones_before[first_of_run][np.cumsum(first_of_run) - 1]
        total += int((ones_before - base)[one == 0].sum())
        rank = rank[np.argsort(rank >> bit, kind="stable")]
    return total


def _inversions(places: DataFrame, group: Sequence[str], block: int, several: bool) -> DataFrame:
    """Pairs with rising ``_px`` and falling ``_py`` per group; both are 1..n.

    Places are cut into blocks of ``block`` in x and in y. Pairs of one x-block are
    counted by one task, pairs of one y-block and different x-blocks by another;
    all other pairs follow from the counts of the grid of blocks alone.
    """
    blocks = places.select(
        *group,
        "_px",
        "_py",
        ((F.col("_px") - 1) / block).cast("bigint").alias("_bx"),
        ((F.col("_py") - 1) / block).cast("bigint").alias("_by"),
    )
    fields = ", ".join(f"`{c}` {places.schema[c].dataType.simpleString()}" for c in group)
    fields = f"{fields}, inversions bigint" if group else "inversions bigint"

    def counted(by: str, order: list[str]) -> DataFrame:
        def within(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            found = count_inversions(pdf.sort_values(order)["_py"].to_numpy())
            return pd.DataFrame([[*keys[:-1], found]], columns=[*group, "inversions"])

        return blocks.groupBy(*group, by).applyInPandas(within, fields)

    # In order of (x-block, y), rows of one x-block show no inversion among themselves.
    found = counted("_bx", ["_px"])
    if several:
        found = found.unionByName(counted("_by", ["_bx", "_py"])).unionByName(_grid_inversions(blocks, group))
    return found.groupBy(*group).agg(F.sum("inversions").alias("inversions"))


def _grid_inversions(blocks: DataFrame, group: Sequence[str]) -> DataFrame:
    """Inversions between rows whose x-blocks and y-blocks both differ, from counts by cell and two prefix sums."""
    cells = durable(blocks.groupBy(*group, "_bx", "_by").agg(F.count(F.lit(1)).alias("_n")))
    sides = cells.groupBy(*group).agg(F.max("_bx").alias("_last"))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("_last"))
    grid = sides.select(*group, F.explode(every).alias("_bx"), "_last").select(*group, "_bx", F.explode(every).alias("_by"))
    full = join_same(grid, cells, [*group, "_bx", "_by"], "left").fillna(0, ["_n"])
    row = Window.partitionBy(*group, "_bx").orderBy(F.desc("_by")).rowsBetween(Window.unboundedPreceding, -1)
    later_y = full.withColumn("_above", F.coalesce(F.sum("_n").over(row), F.lit(0)))
    column = Window.partitionBy(*group, "_by").orderBy("_bx").rowsBetween(Window.unboundedPreceding, -1)
    before = later_y.withColumn("_ahead", F.coalesce(F.sum("_above").over(column), F.lit(0)))
    return before.groupBy(*group).agg(F.sum(F.col("_n") * F.col("_ahead")).alias("inversions"))


def kendall_tau(
    rows: DataFrame,
    group: Sequence[str],
    x: str,
    y: str,
    ties: Sequence[str],
    block_rows: int = BLOCK_ROWS,
    max_group_rows: int = WINDOW_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Tau-b per group without forming pairs; incomplete pairs are left out.

    Discordant pairs are the inversions of y after sorting by (x, y); the
    concordant ones follow from the numbers of tied pairs. Blocks grow with the
    root of the largest group, so that the grid of blocks stays far below its rows.
    """
    extra = [F.col(t) for t in ties]
    narrow = complete_pairs(rows.select(*group, x, y, *ties), x, y)
    largest = largest_group(narrow, group) if largest is None else largest
    limits = {"max_group_rows": max_group_rows, "largest": largest}
    places = ranked(narrow, group, [F.col(x), F.col(y), *extra], "_px", **limits)
    places = ranked(places, group, [F.col(y), F.col(x), *extra], "_py", **limits)
    block = max(block_rows, 4 * isqrt(largest))
    swaps = _inversions(places.select(*group, "_px", "_py"), group, block, largest > block)
    tied_x = _tied_pairs(narrow, group, [x], "_tx")
    tied_y = _tied_pairs(narrow, group, [y], "_ty").drop("_ty_rows")
    tied_xy = _tied_pairs(narrow, group, [x, y], "_txy").drop("_txy_rows")
    keys = list(group)
    joined = tied_x
    for part in (tied_y, tied_xy, swaps):
        joined = join_same(joined, part, keys)
    pairs = F.expr("(_tx_rows * (_tx_rows - 1)) div 2")
    discordant = F.col("inversions")
    concordant = pairs - discordant - F.col("_tx") - F.col("_ty") + F.col("_txy")
    spread = F.sqrt((pairs - F.col("_tx")).cast("double")) * F.sqrt(
        (pairs - F.col("_ty")).cast("double")
    )
    return joined.select(
        *group,
        F.col("_tx_rows").alias("n"),
        ((concordant - discordant) / F.nullif(spread, F.lit(0.0))).alias("kendall"),
    )


def ranking_metrics(
    rows: DataFrame,
    group: Sequence[str],
    x: str,
    y: str,
    ties: Sequence[str],
    max_group_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Pearson, Spearman and Kendall per group; a group without a complete pair has no row."""
    complete = complete_pairs(rows, x, y)
    limits = {"max_group_rows": max_group_rows, "largest": largest_group(complete, group)}
    tau = kendall_tau(complete, group, x, y, ties, **limits).drop("n")
    return join_same(linear_correlations(complete, group, x, y, **limits), tau, group)


def join_experiment(
    experiment: DataFrame, predictions: DataFrame, keys: Sequence[str] = ("target", "id")
) -> DataFrame:
    """Measured values with their predictions; rows without one are dropped."""
    return experiment.join(predictions, list(keys))
