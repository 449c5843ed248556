"""Aromatic rings: geometry, flatness, residue templates and ring contacts.

A ring row has the key columns, ``members`` (atom numbers in ring order),
``points`` (their coordinates), centre ``x, y, z``, plane ``a, b, c, d`` with
``ax + by + cz = d``, ``radius`` and the ``structure`` of its first atom.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dockspan.functions import vectors as V
from dockspan.functions.fixed_values import TEMPLATE_RINGS
from dockspan.functions.literals import literal_table
from dockspan.operators.durable import stored
from dockspan.operators.graph import arcs, enumerate_rings
from dockspan.operators.spatial import distance_join, prefixed

# Limits of ring contacts in length units and degrees.
RING_REACH = 7.5
RING_PADDING = 0.75
PLANE_TOLERANCE = 30.0
EDGE_REACH = 5.0
CATION_REACH = 6.0
FLAT_LIMITS = (15.0, 165.0)


def _point(atom: Column) -> Column:
    return F.struct(atom["x"].alias("x"), atom["y"].alias("y"), atom["z"].alias("z"))


def with_geometry(rings: DataFrame, points: str = "points") -> DataFrame:
    """Add centre, plane and radius from the ordered points of each ring.

    The plane passes through points 1, 3 and 5; rings of four use 1, 2 and 4,
    rings of three all of theirs. Rings of fewer points are dropped.
    """
    p = F.col(points)
    n = F.size(p)

    def mean(axis: str) -> Column:
        total = F.aggregate(p, F.lit(0.0), lambda s, q: s + q[axis])
        return (total / n).alias(axis)

    means = [mean(axis) for axis in "xyz"]
    second = F.when(n >= 5, 2).otherwise(1)
    third = F.when(n >= 5, 4).when(n == 4, 3).otherwise(2)
    centred = rings.filter(n >= 3).select(
        "*",
        *means,
        p[0].alias("_p0"),
        F.get(p, second).alias("_p1"),
        F.get(p, third).alias("_p2"),
    )
    origin = V.field_vec(F.col("_p0"))
    normal = V.cross(
        V.subtract(V.field_vec(F.col("_p1")), origin), V.subtract(V.field_vec(F.col("_p2")), origin)
    )
    radius = F.array_max(F.transform(p, lambda q: V.distance(V.vec(), V.field_vec(q))))
    return centred.select(
        *rings.columns,
        "x",
        "y",
        "z",
        *[c.alias(name) for c, name in zip(normal, "abc")],
        V.dot(normal, origin).alias("d"),
        radius.alias("radius"),
    )


def ring_atoms(
    rings: DataFrame, atoms: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Replace ``members`` by rows of atom columns, in ring order, as ``atoms``."""
    placed = rings.select(
        *keys, "members", F.posexplode("members").alias("_ord", "idx")
    ).join(atoms.select(*keys, "idx", *columns), [*keys, "idx"])
    entry = F.struct("_ord", F.struct("idx", *columns).alias("atom"))
    return placed.groupBy(*keys, "members").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["atom"]).alias("atoms")
    )


def is_flat(atoms: Column) -> Column:
    """No saturated carbon and no torsion away from 0 or 180 degrees.

    ``atoms`` are ring atoms with coordinates, ``element`` and ``around``, the
    coordinates of their bond partners. Torsions are taken over every four
    successive ring atoms and from the last three of them to each partner.
    """
    n = F.size(atoms)
    low, high = FLAT_LIMITS

    def bent(a: Column, b: Column, c: Column, d: Column) -> Column:
        turn = V.degrees(V.dihedral(*[V.field_vec(q) for q in (a, b, c, d)], signed=False))
        return F.exists(F.array(F.abs(turn)), lambda t: (t > low) & (t < high))

    def uneven(four: Column) -> Column:
        q = [four[f"q{i}"] for i in range(4)]
        saturated = (q[3]["element"] == "C") & (F.size(q[3]["around"]) == 4)
        return (
            saturated
            | bent(*q)
            | F.exists(q[3]["around"], lambda s: bent(q[1], q[2], q[3], s))
        )

    def successive(k: Column) -> Column:
        return F.struct(*[F.get(atoms, (k + i) % n).alias(f"q{i}") for i in range(4)])

    fours = F.transform(F.sequence(F.lit(0), n - 1), successive)
    return ~F.exists(fours, uneven)


def molecule_rings(
    atoms: DataFrame,
    bonds: DataFrame,
    keys: Sequence[str],
    sizes: tuple[int, int] = (5, 6),
    flat: bool = True,
) -> DataFrame:
    """Flat rings of five and six atoms in bond graphs, with their geometry."""
    rings = stored(enumerate_rings(bonds, keys).filter(F.size("members").between(*sizes)), "rings")
    # Only the atoms of rings and their partners are looked at from here on.
    wanted = rings.select(*keys, F.explode("members").alias("idx")).distinct()
    partner = atoms.select(*keys, F.col("idx").alias("j"), F.struct("x", "y", "z").alias("_q"))
    entry = F.struct("j", "_q")
    around = (
        arcs(bonds, keys)
        .withColumnRenamed("i", "idx")
        .join(wanted, [*keys, "idx"], "left_semi")
        .join(partner, [*keys, "j"])
        .groupBy(*keys, "idx")
        .agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["_q"]).alias("around"))
    )
    columns = ["x", "y", "z", "element", "structure"]
    described = atoms.select(*keys, "idx", *columns).join(around, [*keys, "idx"])
    filled = ring_atoms(rings, described, keys, [*columns, "around"])
    if flat:
        filled = filled.filter(is_flat(F.col("atoms")))
    return with_geometry(
        filled.select(
            *keys,
            "members",
            F.transform("atoms", _point).alias("points"),
            F.col("atoms")[0]["structure"].alias("structure"),
        )
    )


def template_rings(atoms: DataFrame, residue: Sequence[str]) -> DataFrame:
    """Rings of protein residues by atom name, with their geometry.

    ``residue`` names one run of a residue's atoms; ``resname`` is its type.
    """
    rows = [
        (resname, number, place, name)
        for number, (resnames, names) in enumerate(TEMPLATE_RINGS)
        for resname in resnames
        for place, name in enumerate(names)
    ]
    template = literal_table(
        atoms.sparkSession, rows, "resname string, ring_no int, ord int, name string"
    )
    entry = F.struct("ord", "idx", F.struct("x", "y", "z").alias("q"), "structure")
    found = (
        atoms.join(F.broadcast(template), ["resname", "name"])
        .groupBy(*residue, "resname", "ring_no")
        .agg(F.array_sort(F.collect_list(entry)).alias("_m"))
    )
    return with_geometry(
        found.select(
            *residue,
            "resname",
            "ring_no",
            F.transform("_m", lambda m: m["idx"]).alias("members"),
            F.transform("_m", lambda m: m["q"]).alias("points"),
            F.col("_m")[0]["structure"].alias("structure"),
        )
    )


def plane(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + c) for c in "abcd")


def or_other(structure: Column) -> Column:
    return F.when(structure == "", "OTHER").otherwise(structure)


def ring_stacking(
    ligand_rings: DataFrame, receptor_rings: DataFrame, keys: Sequence[str] = ("target",)
) -> DataFrame:
    """Ring pairs that stack in parallel or stand at a right angle.

    Parallel: planes within the tolerance of 0 or 180 degrees and some atom of
    one ring over the other ring. T-shaped: planes within the tolerance of 90
    degrees, rings close at some atoms, and one centre over the other ring.
    Receptor columns get ``r_``; ``kind`` and ``structure`` describe the pair.
    """
    pairs = distance_join(ligand_rings, prefixed(receptor_rings, "r_", keys), RING_REACH, keys)
    tilt = V.degrees(V.angle(plane()[:3], plane("r_")[:3]))
    measured = pairs.withColumn("plane_angle", tilt)
    tilt = F.col("plane_angle")
    parallel = (tilt < PLANE_TOLERANCE) | (F.abs(tilt - 180) < PLANE_TOLERANCE)
    upright = F.abs(tilt - 90) < PLANE_TOLERANCE

    def over(point, side: str) -> Column:
        foot = V.project(point, plane(side))
        return V.distance(foot, V.vec(side)) <= F.col(f"{side}radius") + RING_PADDING

    stacked = F.exists("points", lambda q: over(V.field_vec(q), "r_")) | F.exists(
        "r_points", lambda q: over(V.field_vec(q), "")
    )
    nearest = F.array_min(
        F.transform(
            "points",
            lambda p: F.array_min(
                F.transform("r_points", lambda q: V.distance(V.field_vec(p), V.field_vec(q)))
            ),
        )
    )
    standing = (nearest <= EDGE_REACH) & (over(V.vec(), "r_") | over(V.vec("r_"), ""))
    kind = F.when(parallel, F.when(stacked, "STACKING")).when(
        upright, F.when(standing, "T-SHAPED")
    )
    # One row per pair with a kind; a filter on it would compute the kind twice.
    return measured.select(
        *[c for c in measured.columns if c != "structure"],
        or_other(F.col("r_structure")).alias("structure"),
        F.explode(F.array_compact(F.array(kind))).alias("kind"),
    )


def cation_ring(
    charges: DataFrame,
    rings: DataFrame,
    keys: Sequence[str] = ("target",),
    receptor_side: str = "ring",
) -> DataFrame:
    """Positive charges over a ring; ring columns get ``r_``.

    The structure class is that of the receptor's group: the ring for charged
    ligands, the charge (``receptor_side='charge'``) for charged receptors.
    """
    pairs = distance_join(
        charges.filter("positive"), prefixed(rings, "r_", keys), CATION_REACH, keys
    )
    foot = V.project(V.vec(), plane("r_"))
    over = V.distance(foot, V.vec("r_")) < F.col("r_radius") + RING_PADDING
    kind = "LIGAND-CHARGED" if receptor_side == "ring" else "RECEPTOR-CHARGED"
    source = "r_structure" if receptor_side == "ring" else "structure"
    found = pairs.filter(over).withColumn("_s", or_other(F.col(source)))
    return found.drop("structure").withColumnRenamed("_s", "structure").withColumn(
        "kind", F.lit(kind)
    )


def count_by_structure(found: DataFrame, pose: Sequence[str]) -> DataFrame:
    return found.groupBy(*pose, "kind", "structure").agg(F.count(F.lit(1)).alias("n"))
