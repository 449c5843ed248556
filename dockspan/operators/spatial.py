"""Distance joins in three dimensions."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame, Window, functions as F

from dockspan.functions import vectors as V
from dockspan.operators.durable import durable
from dockspan.operators.joins import join_same
from dockspan.operators.sizing import BROADCAST_ROWS, fits_broadcast

# Cells are two radii wide, so what is near a point lies in two cells per axis.
MOVES = list(product((0, 1), repeat=3))
# The margin covers rounding of coordinates up to a million radii.
MARGIN = 1 + 1e-6
# A cell number is a weighted sum of the steps along the axes, so a neighbour's
# number differs by a constant. Far-apart cells that share a number only add
# candidates, which the exact test removes.
AXIS_WEIGHTS = {"x": 2**40, "y": 2**20, "z": 1}
# Candidate pairs one task should test for one grid cell.
CELL_PAIRS = 20_000_000
# Pairs a row tested without a grid cost less than copying it to the eight cells around it.
PAIRS_A_ROW = 512


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rename all columns but ``keep`` so that two sides of a join stay apart."""
    return df.select([F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def distance_join(
    left: DataFrame,
    right: DataFrame,
    radius: float,
    keys: Sequence[str] = (),
    inclusive: bool = False,
    name: str = "dist",
    left_prefix: str = "",
    right_prefix: str = "r_",
    max_broadcast_rows: int = BROADCAST_ROWS,
    max_cell_pairs: int = CELL_PAIRS,
    max_pairs_a_row: int = PAIRS_A_ROW,
) -> DataFrame:
    """All pairs of equal ``keys`` closer than ``radius`` (or at it, if ``inclusive``).

    A NULL key equals a NULL key, as in a grouping.
    Both sides are put on a grid and one side looks into the eight cells that
    its surroundings touch, so that the join is an equi-join on ``(keys, cell)``
    followed by the exact test. Pass the smaller side right. While it fits a
    broadcast the left side looks around and is not shuffled at all. Otherwise,
    where groups of ``keys`` are small, both sides are shuffled by ``keys`` alone, once
    and without copies, and every pair of a group is tested. Where they are not, the side of
    fewer rows is copied to the cells it touches, both are shuffled, and cells
    with many candidate pairs are cut on both sides, so that each left part meets
    each right part in one task. Columns other than ``keys`` must differ between
    the two sides.
    """
    on = [*keys, "_cell"]
    if fits_broadcast(right, max_broadcast_rows):
        near_left = _gridded(left, left_prefix, radius, around=True)
        near_right = F.broadcast(_gridded(right, right_prefix, radius))
    else:
        load = _group_load(left, right, keys)
        if keys and load["largest"] <= max_cell_pairs and load["pairs"] <= max_pairs_a_row * load["rows"]:
            near_left, near_right, on = left, right, list(keys)
        else:
            near_left = _gridded(left, left_prefix, radius, around=load["fewer_left"])
            near_right = _gridded(right, right_prefix, radius, around=not load["fewer_left"])
            crowded = _crowded_cells(near_left, near_right, on, max_cell_pairs)
            if not crowded.isEmpty():
                near_left, near_right, on = _cut_crowded_cells(near_left, near_right, on, crowded, max_cell_pairs)
    gap = V.distance(V.vec(left_prefix), V.vec(right_prefix))
    near = gap <= radius if inclusive else gap < radius
    kept = [*left.columns, *[c for c in right.columns if c not in keys]]
    return join_same(near_left, near_right, on).filter(near).select(*kept, gap.alias(name))


def pairs_in_order(
    points: DataFrame,
    order: str,
    radius: float,
    keys: Sequence[str],
    name: str = "dist",
    max_group_pairs: int = CELL_PAIRS,
    max_pairs_a_row: int = PAIRS_A_ROW,
) -> DataFrame:
    """Pairs of points of equal ``keys`` closer than ``radius``, the second (``r_``) with the greater ``order``.

    Where groups are small, points are shuffled and sorted once and each meets those after it in its
    group, so there is no join and no second copy. Otherwise this is :func:`distance_join`.
    """
    others = [c for c in points.columns if c not in keys]
    size = F.col("_n").cast("double")
    load = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum(size), F.lit(0.0)).alias("rows"),
        F.coalesce(F.sum(size * size), F.lit(0.0)).alias("pairs"),
        F.coalesce(F.max(size * size), F.lit(0.0)).alias("largest"),
    ).first()
    later = F.col(order) < F.col(f"r_{order}")
    if not keys or load["largest"] > max_group_pairs or load["pairs"] > max_pairs_a_row * load["rows"]:
        return distance_join(points, prefixed(points, "r_", keys), radius, keys, name=name).filter(later)
    after = Window.partitionBy(*keys).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    rest = F.collect_list(F.struct(*[F.col(c).alias(f"r_{c}") for c in others])).over(after)
    pairs = points.select("*", rest.alias("_after")).select(*points.columns, F.inline("_after"))
    gap = V.distance(V.vec(""), V.vec("r_"))
    return pairs.filter(later & (gap < radius)).select("*", gap.alias(name))


def _gridded(df: DataFrame, prefix: str, radius: float, around: bool = False) -> DataFrame:
    """Add the grid cell of each point, or a row for each cell around it."""
    reach = radius * MARGIN
    corner = reach if around else 0.0
    cell = sum(
        F.floor((F.col(prefix + a) - corner) / (2 * reach)) * w for a, w in AXIS_WEIGHTS.items()
    )
    if not around:
        return df.withColumn("_cell", cell)
    steps = [sum(d * w for d, w in zip(move, AXIS_WEIGHTS.values())) for move in MOVES]
    at = df.withColumn("_at", cell)
    cells = F.explode(F.array(*[F.col("_at") + s for s in steps]))
    return at.select(*df.columns, cells.alias("_cell"))


def _histogram(left, right, on) -> DataFrame:
    """Rows of both sides, ``_l`` and ``_r``, for every value of ``on``."""
    sides = [
        side.select(*on, F.lit(own).alias("_l"), F.lit(1 - own).alias("_r")) for side, own in ((left, 1), (right, 0))
    ]
    return sides[0].unionAll(sides[1]).groupBy(*on).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))


def _group_load(left, right, keys):
    """Rows and pairs of all groups, pairs of the largest one, and whether the left side has fewer rows."""
    pairs = F.col("_l").cast("double") * F.col("_r")
    return (
        _histogram(left, right, keys)
        .agg(
            F.coalesce(F.sum(F.col("_l") + F.col("_r")), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(pairs), F.lit(0.0)).alias("pairs"),
            F.coalesce(F.max(pairs), F.lit(0.0)).alias("largest"),
            F.coalesce(F.sum("_l") < F.sum("_r"), F.lit(False)).alias("fewer_left"),
        )
        .first()
    )


def _crowded_cells(left, right, on, max_cell_pairs) -> DataFrame:
    """Cells with more candidate pairs than one task should test, from one histogram of both sides."""
    load = _histogram(left, right, on)
    # At most (all candidate pairs / max_cell_pairs) rows are stored.
    return durable(load.filter(F.col("_l").cast("double") * F.col("_r") > max_cell_pairs))


def _cut_crowded_cells(left, right, on, load, max_cell_pairs):
    # Parts of this many rows on both sides give max_cell_pairs; a side shorter than that stays
    # whole and the other one is cut the finer.
    side = float(max_cell_pairs) ** 0.5
    few, many = F.least("_l", "_r"), F.greatest("_l", "_r")
    few_parts = F.ceil(few / side)
    many_parts = F.ceil(many * F.ceil(few / few_parts) / max_cell_pairs)
    left_few = F.col("_l") <= F.col("_r")
    crowded = load.select(
        *on,
        F.when(left_few, few_parts).otherwise(many_parts).cast("int").alias("_lparts"),
        F.when(left_few, many_parts).otherwise(few_parts).cast("int").alias("_rparts"),
    )
    if fits_broadcast(crowded):
        crowded = F.broadcast(crowded)

    def dealt(df: DataFrame, own: str, own_parts: str, other: str, other_parts: str) -> DataFrame:
        parts = F.coalesce(own_parts, F.lit(1))
        place = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), parts).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(other_parts, F.lit(1)) - 1))
        return join_same(df, crowded, on, "left").select(*df.columns, place.alias(own), copies.alias(other))

    return (
        dealt(left, "_lpart", "_lparts", "_rpart", "_rparts"),
        dealt(right, "_rpart", "_rparts", "_lpart", "_lparts"),
        [*on, "_lpart", "_rpart"],
    )


def bounding_box(atoms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest and largest coordinate per axis for each group."""
    sides = [
        f(a).alias(f"{n}_{a}") for a in ("x", "y", "z") for n, f in (("min", F.min), ("max", F.max))
    ]
    return atoms.groupBy(*keys).agg(*sides)


def inside_box(
    atoms: DataFrame,
    boxes: DataFrame,
    keys: Sequence[str],
    margin: float,
    cell: float = 8.0,
    max_group_pairs: int = CELL_PAIRS,
    max_pairs_a_row: int = PAIRS_A_ROW // 8,
) -> DataFrame:
    """Pairs of an atom and a box of equal ``keys`` that strictly contains it.

    Where groups of ``keys`` are small every atom of a group is tested against every box of it.
    Where they are not, a widened box is put on a grid as wide as itself, rounded up to a power of
    two cells, and so covers at most eight places of it; an atom lies in one
    place of every grid in use. Box columns other than the limits are added to
    the atom's columns.
    """
    axes = ("x", "y", "z")
    cells = ["_cx", "_cy", "_cz"]
    extra = [c for c in boxes.columns if c not in keys and c[:4] not in ("min_", "max_")]
    tests = [
        (F.col(a) > F.col(f"min_{a}") - margin) & (F.col(a) < F.col(f"max_{a}") + margin)
        for a in axes
    ]
    load = _group_load(atoms, boxes, keys)
    if keys and load["largest"] <= max_group_pairs and load["pairs"] <= max_pairs_a_row * load["rows"]:
        near = F.broadcast(boxes) if fits_broadcast(boxes, BROADCAST_ROWS // 10) else boxes
        return atoms.join(near, list(keys)).filter(tests[0] & tests[1] & tests[2]).select(*atoms.columns, *extra)
    widest = F.greatest(*[F.col(f"max_{a}") - F.col(f"min_{a}") for a in axes]) + 2 * margin
    level = F.greatest(F.ceil(F.log2(widest / cell)), F.lit(0)).cast("int")
    covered = boxes.filter(widest > 0).withColumn("_level", level)
    # There are no more levels than powers of two between the cell and the largest number.
    levels = [r["_level"] for r in covered.select("_level").distinct().collect()]
    width = F.pow(F.lit(2.0), F.col("_level")) * cell
    for axis, name in zip(axes, cells):
        first = F.floor((F.col(f"min_{axis}") - margin) / width)
        last = F.floor((F.col(f"max_{axis}") + margin) / width)
        covered = covered.withColumn(name, F.explode(F.sequence(first, last)))
    if fits_broadcast(covered, BROADCAST_ROWS // 10):
        covered = F.broadcast(covered)
    used = F.array(*[F.lit(n) for n in sorted(levels)]).cast("array<int>")
    gridded = atoms.withColumn("_level", F.explode(used))
    gridded = gridded.select("*", *[F.floor(F.col(a) / width).alias(n) for a, n in zip(axes, cells)])
    return (
        gridded.join(covered, [*keys, "_level", *cells])
        .filter(tests[0] & tests[1] & tests[2])
        .select(*atoms.columns, *extra)
    )
