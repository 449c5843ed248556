"""Charged groups of residues and small molecules, and salt bridges.

A charge row has the key columns, ``members``, position ``x, y, z``,
``positive`` and the ``structure`` class of its first member.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dockspan.functions import vectors as V
from dockspan.functions.fixed_values import METALS, TEMPLATE_CHARGES
from dockspan.functions.literals import literal_table
from dockspan.operators.graph import arcs
from dockspan.operators.rings import or_other
from dockspan.operators.spatial import distance_join, prefixed

# Salt-bridge distance, and the mean angle at a nitrogen with
# three neighbours that makes it count as charged, in degrees.
SALT_REACH = 5.5
AMINE_ANGLE, AMINE_TOLERANCE = 109.0, 5.0


def template_charges(atoms: DataFrame, residue: Sequence[str]) -> DataFrame:
    """Charged groups of protein residues by atom name.

    The position is the mean of the named atoms; a lysine uses its first NZ.
    """
    rows = [
        (resname, name, positive, len(names) == 1)
        for resnames, names, positive in TEMPLATE_CHARGES
        for resname in resnames
        for name in names
    ]
    template = literal_table(
        atoms.sparkSession, rows, "resname string, name string, positive boolean, single boolean"
    )
    at = F.struct("x", "y", "z")
    found = (
        atoms.join(F.broadcast(template), ["resname", "name"])
        .groupBy(*residue, "resname", "positive", "single")
        .agg(
            *[F.avg(c).alias(f"_mean_{c}") for c in "xyz"],
            F.min_by(at, "idx").alias("_first"),
            F.array_sort(F.collect_list("idx")).alias("_all"),
            F.min_by("structure", "idx").alias("structure"),
        )
    )
    single = F.col("single")
    placed = found.select(
        *residue,
        "resname",
        F.when(single, F.slice("_all", 1, 1)).otherwise(F.col("_all")).alias("members"),
        *[
            F.when(single, F.col("_first")[c]).otherwise(F.col(f"_mean_{c}")).alias(c)
            for c in "xyz"
        ],
        "positive",
        "structure",
        "single",
    )
    origin = (F.col("x") == 0) & (F.col("y") == 0) & (F.col("z") == 0)
    return placed.filter(single | ~origin).drop("single")


def neighbourhoods(atoms: DataFrame, bonds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Atoms with their bond partners in index order, as ``partners``.

    A partner carries its own degree, heavy degree and hydrogens. Lists are as
    long as an atom's valence.
    """
    both = arcs(bonds, keys)
    partner = atoms.select(*keys, F.col("idx").alias("j"), F.col("element").alias("_e"))
    degrees = (
        both.join(partner, [*keys, "j"])
        .groupBy(*keys, F.col("i").alias("idx"))
        .agg(
            F.count(F.lit(1)).alias("degree"),
            F.count_if(F.col("_e") != "H").alias("heavy"),
            F.array_sort(F.collect_list(F.when(F.col("_e") == "H", F.col("j")))).alias("hydrogens"),
        )
    )
    described = atoms.select(*keys, "idx", "element", "x", "y", "z").join(degrees, [*keys, "idx"])
    entry = F.struct("idx", "element", "x", "y", "z", "degree", "heavy", "hydrogens")
    partners = (
        both.join(described.withColumnRenamed("idx", "j"), [*keys, "j"])
        .withColumn("idx", F.col("j"))
        .groupBy(*keys, "i")
        .agg(F.array_sort(F.collect_list(entry)).alias("partners"))
        .withColumnRenamed("i", "idx")
    )
    return atoms.join(partners, [*keys, "idx"], "left")


def molecule_charges(atoms: DataFrame, bonds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Charged groups of small molecules from elements and bonds alone.

    Positive: metals, nitrogens with four partners or three at tetrahedral
    angles, and carbons between two end nitrogens next to a saturated or
    hetero atom. Negative: carboxylates, and phosphorus or sulphur with at
    least two or three end oxygens.
    """
    hood = neighbourhoods(atoms, bonds, keys)
    element, n = F.col("element"), F.coalesce(F.size(F.col("partners")), F.lit(0))
    here = V.vec()

    def of(symbol: str) -> Column:
        return F.filter("partners", lambda p: p["element"] == symbol)

    def ends(symbol: str) -> Column:
        return F.filter("partners", lambda p: (p["element"] == symbol) & (p["heavy"] == 1))

    def ids(group: Column) -> Column:
        return F.transform(group, lambda p: p["idx"])

    def bend(a: int, b: int) -> Column:
        return V.degrees(
            V.angle_at(
                V.field_vec(F.get("partners", F.lit(a))),
                here,
                V.field_vec(F.get("partners", F.lit(b))),
            )
        )

    def charge(positive: bool, members: Column, at: Sequence[Column] | None = None) -> Column:
        x, y, z = here if at is None else at
        return F.struct(
            F.lit(positive).alias("positive"),
            members.alias("members"),
            x.alias("x"),
            y.alias("y"),
            z.alias("z"),
        )

    def midpoint(group: Column) -> list[Column]:
        return [(F.get(group, F.lit(0))[c] + F.get(group, F.lit(1))[c]) / 2.0 for c in "xyz"]

    own = F.array("idx")
    with_partners = F.concat(own, ids(F.col("partners")))
    mean_angle = (bend(0, 1) + bend(0, 2) + bend(1, 2)) / 3
    amine = (element == "N") & (
        (n == 4) | ((n == 3) & (F.abs(mean_angle - AMINE_ANGLE) < AMINE_TOLERANCE))
    )
    end_n, end_o = ends("N"), ends("O")
    linker = F.get(
        F.filter("partners", lambda p: ~((p["element"] == "N") & (p["heavy"] == 1))), F.lit(0)
    )
    joins_on = (
        linker["element"].isin("N", "S", "P")
        | ((linker["element"] == "C") & (linker["degree"] == 4))
        | ((linker["element"] == "O") & (linker["degree"] == 2))
    )
    guanidino = (element == "C") & (n == 3) & (F.size(end_n) == 2) & joins_on
    end_hydrogens = F.flatten(F.transform(end_n, lambda p: p["hydrogens"]))
    carboxylate = (element == "C") & (n == 3) & (F.size(of("O")) == 2) & (F.size(end_o) == 2)
    oxygens = F.concat(own, ids(of("O")))
    rule = (
        F.when(element.isin(METALS), charge(True, own))
        .when(amine, charge(True, with_partners))
        .when(guanidino, charge(True, F.concat(own, ids(end_n), end_hydrogens), midpoint(end_n)))
        .when(
            carboxylate,
            charge(
                False,
                F.concat(F.slice(ids(end_o), 1, 1), own, F.slice(ids(end_o), 2, 1)),
                midpoint(end_o),
            ),
        )
        .when((element == "P") & (F.size(end_o) >= 2), charge(False, oxygens))
        .when((element == "S") & (F.size(end_o) >= 3), charge(False, oxygens))
    )
    # One row per atom that a rule applies to; the rule is computed once.
    found = hood.select(
        *keys, "idx", "structure", F.explode(F.array_compact(F.array(rule))).alias("_charge")
    )
    return found.select(
        *keys,
        "idx",
        F.col("_charge.members").alias("members"),
        *[F.col(f"_charge.{c}").alias(c) for c in "xyz"],
        F.col("_charge.positive").alias("positive"),
        "structure",
    )


def opposite_charges(
    ligand_charges: DataFrame, receptor_charges: DataFrame, keys: Sequence[str] = ("target",)
) -> DataFrame:
    """Salt bridges: opposite charges closer than the reach; receptor columns get ``r_``."""
    pairs = distance_join(
        ligand_charges, prefixed(receptor_charges, "r_", keys), SALT_REACH, keys
    )
    found = pairs.filter(F.col("positive") != F.col("r_positive"))
    return (
        found.drop("structure")
        .withColumn("structure", or_other(F.col("r_structure")))
        .withColumn("kind", F.lit("SALT-BRIDGE"))
    )
