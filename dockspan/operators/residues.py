"""Residue sequences: runs, backbone torsions and structure classes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from dockspan.functions import vectors as V
from dockspan.functions.fixed_values import BACKBONE_NAMES
from dockspan.operators.durable import durable, scratch_table
from dockspan.operators.joins import join_same
from dockspan.operators.ordering import (
    BLOCK_ROWS,
    WINDOW_ROWS,
    ranked,
    running_by_position,
    with_neighbours,
)
from dockspan.operators.spatial import distance_join, prefixed

# Fixed value: distance of alpha carbons that support a helix or sheet.
SUPPORT_REACH = 6.0
# Longest run that is too short, by class.
SHORT_RUNS = {"ALPHA": 4, "BETA": 2}
KINDS = {name: number for number, name in enumerate(SHORT_RUNS, 1)}
# Rows and supporting pairs of a group that one task settles; some 200 MB.
GROUP_ROWS, GROUP_PAIRS = 200_000, 4_000_000


def number_runs(
    rows: DataFrame,
    group: Sequence[str],
    position: str,
    same: Sequence[str],
    name: str = "run",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Number from 1 the runs of successive rows that agree in ``same``.

    A value that comes back after another one starts a new run. ``position``
    numbers the rows of a group densely.
    """
    def changed(window) -> dict[str, Column]:
        agree = [F.col(c).eqNullSafe(F.lag(c).over(window)) for c in same]
        whole = agree[0]
        for part in agree[1:]:
            whole = whole & part
        first = F.lag(position).over(window).isNull()
        return {"_new": F.when(first | ~whole, 1).otherwise(0)}

    flagged = with_neighbours(rows, group, position, 1, changed, block_rows)
    numbered = running_by_position(flagged, group, position, F.col("_new"), name, block_rows)
    return numbered.drop("_new")


def backbone_residues(
    atoms: DataFrame, keys: Sequence[str], max_group_rows: int = WINDOW_ROWS
) -> DataFrame:
    """Residues with their four backbone atoms, one row each, numbered by ``run``."""
    backbone = atoms.filter(F.col("name").isin(BACKBONE_NAMES))
    placed = ranked(backbone, keys, [F.col("idx")], "_at", max_group_rows)
    runs = number_runs(placed, keys, "_at", ["resid", "chain"])
    at = F.struct("x", "y", "z")
    return runs.groupBy(*keys, "run", "resid", "chain").agg(
        F.count(F.lit(1)).alias("n_backbone"),
        *[
            F.max_by(F.when(F.col("name") == n, at), F.when(F.col("name") == n, F.col("idx"))).alias(
                n.lower()
            )
            for n in ("N", "CA", "C")
        ],
    )


def torsion_class(phi: Column, psi: Column) -> Column:
    """Class of a residue pair by its two torsions in degrees, or NULL."""
    alpha = (phi > -145) & (phi < -35) & (psi > -70) & (psi < 50)
    beta = ((phi >= -180) & (phi < -40) & (psi <= 180) & (psi > 90)) | (
        (phi >= -180) & (phi < -70) & (psi <= -165)
    )
    return F.when(beta, "BETA").when(alpha, "ALPHA")


def torsion_pairs(
    residues: DataFrame, keys: Sequence[str], skip_first: bool = False
) -> DataFrame:
    """Torsions of successive residues of one chain, for complete residues.

    ``skip_first`` leaves out the pair at the very start of a structure.
    """
    def following(window) -> dict[str, Column]:
        next_row = F.struct("resid", "chain", "n", "ca", "c", "n_backbone")
        return {"_next": F.lead(next_row).over(window)}

    pairs = with_neighbours(residues, keys, "run", 1, following).filter(
        (F.col("n_backbone") == 4)
        & (F.col("_next.n_backbone") == 4)
        & (F.col("resid") + 1 == F.col("_next.resid"))
        & (F.col("chain") == F.col("_next.chain"))
    )
    if skip_first:
        pairs = pairs.filter(F.col("run") > 1)
    here = {n: V.field_vec(F.col(n)) for n in ("n", "ca", "c")}
    after = {n: V.field_vec(F.col(f"_next.{n}")) for n in ("n", "ca", "c")}
    phi = V.degrees(V.dihedral(here["c"], after["n"], after["ca"], after["c"]))
    psi = V.degrees(V.dihedral(here["n"], here["ca"], here["c"], after["n"]))
    measured = pairs.select(
        *keys,
        "run",
        "chain",
        "resid",
        F.col("_next.resid").alias("next_resid"),
        phi.alias("phi"),
        psi.alias("psi"),
    )
    return measured.withColumn("class", torsion_class(F.col("phi"), F.col("psi")))


def residue_classes(residues: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Class of each residue: that of the last classified pair it is in, or OTHER."""
    both = F.array("resid", "next_resid")
    votes = pairs.select(*keys, "chain", F.explode(both).alias("resid"), "run", "class")
    # Pairs without a class have no vote; a filter on the class would make the
    # optimizer repeat the whole torsion expression.
    place = F.when(F.col("class").isNotNull(), F.col("run"))
    last = votes.groupBy(*keys, "chain", "resid").agg(F.max_by("class", place).alias("class"))
    every = residues.select(*keys, "chain", "resid").distinct()
    return join_same(every, last, [*keys, "chain", "resid"], "left").withColumn(
        "class", F.coalesce("class", F.lit("OTHER"))
    )


def _supports(carbons: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs of alpha carbons of one class that support each other."""
    classed = carbons.filter("class <> 'OTHER'").select(*keys, "position", "resid", "chain", "class", "x", "y", "z")
    near = distance_join(classed, prefixed(classed, "r_", keys), SUPPORT_REACH, keys)
    apart = F.abs(F.col("resid") - F.col("r_resid"))
    helix = (F.col("class") == "ALPHA") & (apart == 3)
    sheet = (F.col("class") == "BETA") & (apart > 2) & (F.col("chain") == F.col("r_chain"))
    held = near.filter((F.col("class") == F.col("r_class")) & (helix | sheet))
    return held.select(*keys, "position", F.col("r_position").alias("other"), "class")


def _in_frames(carbons: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the stretch of successive residue numbers and its length."""
    def breaks(window) -> dict[str, Column]:
        before = F.lag("resid").over(window)
        return {"_new": F.when(before + 1 == F.col("resid"), 0).otherwise(1)}

    flagged = with_neighbours(carbons, keys, "position", 1, breaks)
    stretched = running_by_position(flagged, keys, "position", F.col("_new"), "stretch")
    lengths = stretched.groupBy(*keys, "stretch").agg(F.count(F.lit(1)).alias("stretch_length"))
    return join_same(stretched.drop("_new"), lengths, [*keys, "stretch"])


def _too_short(window, kind: str) -> Column:
    """Whether a row is in a short run of ``kind`` between two other rows.

    Both of those rows must be in the same stretch, and the stretch must hold a
    whole frame of the longest short run with its two ends.
    """
    limit = SHORT_RUNS[kind]

    def gap(look) -> Column:
        steps = None
        for k in range(limit, 0, -1):
            there = look("class", k).over(window)
            inside = look("stretch", k).over(window) == F.col("stretch")
            ends = inside & (there != kind)
            stays = inside & (there == kind)
            onward = F.lit(None).cast("int") if steps is None else steps
            steps = F.when(ends, F.lit(k)).when(stays, onward)
        return steps

    run = gap(F.lag) + gap(F.lead) - 1
    return (F.col("class") == kind) & (run <= limit) & (F.col("stretch_length") >= limit + 2)


class Pruning:
    """The removals of one group by a worklist.

    ``counts`` holds how many supporting partners every row has left. A wave takes
    the support of its partners away and looks again only at these and at rows
    near the fallen ones, so all waves together look at every pair once.
    """

    def __init__(self, kinds: np.ndarray, stretch: np.ndarray, length: np.ndarray, residue: np.ndarray):
        self.kinds, self.stretch, self.length, self.residue = kinds, stretch, length, residue
        self.by_residue = np.argsort(residue, kind="stable")
        self.residues = residue[self.by_residue]

    def too_short(self, rows: np.ndarray, kind: int, limit: int) -> np.ndarray:
        """Which of ``rows`` are in a run of at most ``limit`` rows of ``kind`` between two other rows."""
        size = len(self.kinds)

        def gap(side: int) -> np.ndarray:
            steps = np.full(len(rows), -size)
            for k in range(limit, 0, -1):
                there = rows + side * k
                inside = (there >= 0) & (there < size)
                at = np.where(inside, there, 0)
                inside &= self.stretch[at] == self.stretch[rows]
                ends = inside & (self.kinds[at] != kind)
                steps = np.where(ends, k, np.where(inside, steps, -size))
            return steps

        back, ahead = gap(-1), gap(1)
        held = (self.kinds[rows] == kind) & (self.length[rows] >= limit + 2)
        return held & (back > 0) & (ahead > 0) & (back + ahead - 1 <= limit)

    def run(self, position: np.ndarray, other: np.ndarray) -> int:
        """Remove classes until all that are left may stay; returns the number of waves."""
        size = len(self.kinds)
        counts = np.bincount(position, minlength=size)
        order = np.argsort(other, kind="stable")
        partners, edges = position[order], np.searchsorted(other[order], np.arange(size + 1))
        reach = np.arange(-max(SHORT_RUNS.values()) - 1, max(SHORT_RUNS.values()) + 2)
        look, waves = np.flatnonzero(self.kinds), 0
        while len(look):
            fall = counts[look] == 0
            for number, limit in enumerate(SHORT_RUNS.values(), 1):
                fall |= self.too_short(look, number, limit)
            # All carbons of one residue change together.
            touched = np.unique(self.residue[look[fall]])
            first, end = (np.searchsorted(self.residues, touched, side) for side in ("left", "right"))
            gone = self.by_residue[_ranges(first, end)]
            gone = gone[self.kinds[gone] > 0]
            if not len(gone):
                break
            waves += 1
            self.kinds[gone] = 0
            lost = partners[_ranges(edges[gone], edges[gone + 1])]
            np.subtract.at(counts, lost, 1)
            near = (gone[:, None] + reach).ravel()
            look = np.unique(np.concatenate([lost, near[(near >= 0) & (near < size)]]))
            look = look[self.kinds[look] > 0]
        return waves


def _ranges(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Numbers from every ``first`` to before its ``end``."""
    lengths = end - first
    total = np.cumsum(lengths)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(first - total + lengths, lengths)


def _settle_groups(state: DataFrame, support: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pruned rows of groups that each fit one task."""

    def settle(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        rows = rows.sort_by("position")
        names = rows.column("class").to_pylist()
        kinds = np.array([KINDS.get(name, 0) for name in names], np.int64)
        places = rows.column("position").to_numpy()
        residues = [rows.column(c).combine_chunks().dictionary_encode("encode").indices.to_numpy() for c in ("chain", "resid")]
        residue = np.unique(np.stack(residues), axis=1, return_inverse=True)[1].ravel()
        group = Pruning(kinds, rows.column("stretch").to_numpy(), rows.column("stretch_length").to_numpy(), residue)
        before = kinds.copy()
        # A side without rows of the group comes without columns.
        held = [pairs.column(c).to_numpy() if c in pairs.column_names else places[:0] for c in ("_from", "_to")]
        group.run(*(np.searchsorted(places, side) for side in held))
        fallen = pa.array(group.kinds != before)
        kept = pc.if_else(fallen, "OTHER", rows.column("class"))
        return rows.set_column(rows.schema.get_field_index("class"), "class", kept)

    # New names keep the two sides apart where they come from one table.
    named = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    pairs = support.select(*named, F.col("position").alias("_from"), F.col("other").alias("_to"))
    both = state.groupBy(*keys).cogroup(pairs.groupBy(*[f"_key{i}" for i in range(len(keys))]))
    return both.applyInArrow(settle, state.schema)


def prune_runs(
    carbons: DataFrame,
    keys: Sequence[str],
    max_group_rows: int = GROUP_ROWS,
    max_group_pairs: int = GROUP_PAIRS,
) -> DataFrame:
    """Remove unsupported and too short helices and strands until none is left.

    ``carbons`` has one alpha carbon per row: ``keys``, dense ``position`` in
    load order, ``chain, resid, x, y, z`` and ``class``. A class without a
    supporting partner of the same class, or in a too short run, becomes OTHER.
    Removals only make more removals possible, so the result does not depend on
    their order. A group of bounded rows and pairs is settled by one task with a
    worklist; larger ones take passes over all of their rows, and a group that a
    pass leaves as it is takes no part in the next one.
    """
    whole = list(keys) or ["_group"]
    rows = carbons if keys else carbons.withColumn("_group", F.lit(0))
    support = durable(_supports(rows, whole))
    state = durable(_in_frames(rows, whole))
    counts = state.select(*whole, F.lit(1).alias("_rows"), F.lit(0).alias("_pairs")).union(
        support.select(*whole, F.lit(0), F.lit(1))
    )
    sums = counts.groupBy(*whole).agg(F.sum("_rows").alias("_rows"), F.sum("_pairs").alias("_pairs"))
    large = durable(
        sums.filter((F.col("_rows") > max_group_rows) | (F.col("_pairs") > max_group_pairs)).select(*whole)
    )
    if large.isEmpty():
        pruned = _settle_groups(state, support, whole)
    else:
        small = [join_same(df, large, whole, "left_anti") for df in (state, support)]
        big = [join_same(df, large, whole, "left_semi") for df in (state, support)]
        pruned = _settle_groups(*small, whole).unionByName(_settle_in_passes(*big, whole))
    return pruned.select(*carbons.columns)


def _settle_in_passes(state: DataFrame, support: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pruned rows of groups of any size; every pass but the last removes a class."""
    spark = state.sparkSession
    columns = state.columns
    settled = scratch_table(spark, "settled")
    while True:
        members = state.select(
            *keys, F.col("position").alias("other"), "class"
        ).filter("class <> 'OTHER'")
        held = (
            join_same(support, members, [*keys, "other", "class"])
            .select(*keys, "position", "class")
            .distinct()
            .withColumn("_held", F.lit(True))
        )

        def shortness(window) -> dict[str, Column]:
            return {"_short": _too_short(window, "ALPHA") | _too_short(window, "BETA")}

        judged = with_neighbours(state, keys, "position", max(SHORT_RUNS.values()) + 1, shortness)
        drop = (F.col("class") != "OTHER") & (
            F.col("_held").isNull() | F.coalesce("_short", F.lit(False))
        )
        # All carbons of one residue change together.
        residue = Window.partitionBy(*keys, "chain", "resid")
        marked = join_same(judged, held, [*keys, "position", "class"], "left").withColumn(
            "_gone", F.max(drop).over(residue)
        )
        state = durable(
            marked.withColumn("class", F.when(F.col("_gone"), "OTHER").otherwise(F.col("class")))
            .select(*columns, "_gone")
        )
        moving = durable(state.filter("_gone").select(*keys).distinct())
        state = state.select(*columns)
        if moving.isEmpty():
            break
        join_same(state, moving, keys, "left_anti").write.mode("append").parquet(settled)
        state = join_same(state, moving, keys, "left_semi")
        support = join_same(support, moving, keys, "left_semi")
    state.write.mode("append").parquet(settled)
    return spark.read.parquet(settled)
