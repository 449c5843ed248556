"""Counting contacts between ligand poses and receptors.

Atom tables have ``x, y, z`` and, as far as a function uses them, ``charge,
atom_type, element, name, structure``. Ligand rows also carry the pose key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dockspan.functions import vectors as V
from dockspan.functions.fixed_values import BACKBONE_NAMES, COULOMB_FACTOR
from dockspan.operators.joins import join_same
from dockspan.operators.spatial import distance_join, prefixed

# Distances that bound contacts and hydrogen bonds, and the
# largest deviation of a hydrogen bond from a straight line in degrees.
CLOSEST, CLOSE = 2.5, 4.0
HYDROGEN_REACH = 1.3
HYDROGEN_ANGLE = 40.0
TYPED_PAIR_REACH = 6.0


def side_of_chain(name: Column) -> Column:
    return F.when(name.isin(BACKBONE_NAMES), "BACKBONE").otherwise("SIDECHAIN")


def pair_key(a: Column, b: Column) -> Column:
    """Two type names in alphabetical order, joined by ``_``."""
    return F.concat_ws("_", F.least(a, b), F.greatest(a, b))


def contact_pairs(
    ligands: DataFrame, receptors: DataFrame, keys: Sequence[str] = ("target",), radius: float = CLOSE
) -> DataFrame:
    """Ligand-receptor atom pairs closer than ``radius``; receptor columns get ``r_``."""
    return distance_join(ligands, prefixed(receptors, "r_", keys), radius, keys)


def contact_counts(
    pairs: DataFrame, pose: Sequence[str], bands: tuple[float, float] = (CLOSEST, CLOSE)
) -> DataFrame:
    """Pairs per sorted type pair in two disjoint bands: ``closest`` and ``close``."""
    near = F.col("dist") < bands[0]
    inside = F.col("dist") < bands[1]
    return (
        pairs.filter(inside)
        .groupBy(*pose, pair_key(F.col("atom_type"), F.col("r_atom_type")).alias("pair"))
        .agg(F.count_if(near).alias("closest"), F.count_if(~near).alias("close"))
    )


def coulomb(dist: str = "dist") -> Column:
    """Coulomb energy of a pair in J/mol; NULL for atoms at the same place."""
    return F.col("charge") * F.col("r_charge") / F.nullif(F.col(dist), F.lit(0.0)) * COULOMB_FACTOR


def coulomb_sums(pairs: DataFrame, pose: Sequence[str], radius: float = CLOSE) -> DataFrame:
    """Coulomb energy per sorted type pair over all pairs closer than ``radius``."""
    return (
        pairs.filter(F.col("dist") < radius)
        .groupBy(*pose, pair_key(F.col("atom_type"), F.col("r_atom_type")).alias("pair"))
        .agg(F.sum(coulomb()).alias("energy"))
    )


def contact_categories(pairs: DataFrame, pose: Sequence[str], radius: float = CLOSE) -> DataFrame:
    """Contacts and carbon-carbon contacts per chain side and structure class."""
    carbons = (F.col("element") == "C") & (F.col("r_element") == "C")
    return (
        pairs.filter(F.col("dist") < radius)
        .groupBy(
            *pose,
            side_of_chain(F.col("r_name")).alias("chain_side"),
            F.col("r_structure").alias("structure"),
        )
        .agg(F.count(F.lit(1)).alias("contacts"), F.count_if(carbons).alias("carbon_contacts"))
    )


def ligand_type_flags(
    ligands: DataFrame, pose: Sequence[str], types: Sequence[str] = ("N", "HD")
) -> DataFrame:
    """Per pose, 1 for each listed atom type that occurs and 0 otherwise."""
    flags = [
        F.when(F.count_if(F.col("atom_type") == t) > 0, 1).otherwise(0).alias(f"la_{t.lower()}")
        for t in types
    ]
    return ligands.groupBy(*pose).agg(F.count(F.lit(1)).alias("n_atoms"), *flags)


def hydrogen_bonds(
    ligands: DataFrame,
    receptors: DataFrame,
    pose: Sequence[str],
    keys: Sequence[str] = ("target",),
    atom_id: str = "atom_id",
    radius: float = CLOSE,
    reach: float = HYDROGEN_REACH,
    max_bend: float = HYDROGEN_ANGLE,
) -> DataFrame:
    """Every (ligand atom, hydrogen, receptor atom) that forms a hydrogen bond.

    Both atoms are N or O and closer than ``radius``; the hydrogen is within
    ``reach`` of the atom on its own side and the three are near a line.
    ``donor`` tells which side the hydrogen belongs to.
    """
    polar = F.col("element").isin("N", "O")

    def with_hydrogens(atoms: DataFrame, own: Sequence[str]) -> DataFrame:
        # An atom has few hydrogens near it; they travel as an array through the one large join.
        hydrogens = atoms.filter(F.col("element") == "H").select(
            *own, F.col(atom_id).alias("h_atom"), *[F.col(a).alias(f"h_{a}") for a in "xyz"]
        )
        heavy = atoms.filter(polar).select(*own, atom_id, *[F.col(a).alias(f"a_{a}") for a in "xyz"])
        near = distance_join(
            heavy, hydrogens, reach, own, name="h_dist", left_prefix="a_", right_prefix="h_"
        )
        found = near.groupBy(*own, atom_id).agg(
            F.collect_list(F.struct("h_atom", "h_x", "h_y", "h_z")).alias("hydrogens")
        )
        return join_same(atoms.filter(polar), found, [*own, atom_id], "left")

    columns = ["x", "y", "z", "name", "structure", "hydrogens"]
    ligand_atoms = with_hydrogens(ligands, pose).select(
        *pose, F.col(atom_id).alias("ligand_atom"), *columns[:3], "hydrogens"
    )
    receptor_atoms = with_hydrogens(receptors, keys).select(
        *keys, F.col(atom_id).alias("receptor_atom"), *columns
    )
    pairs = contact_pairs(ligand_atoms, receptor_atoms, keys, radius)

    def donated(hydrogens: str, side: str) -> Column:
        return F.transform(hydrogens, lambda h: F.struct(F.lit(side).alias("donor"), h.alias("h")))

    sides = F.array(donated("hydrogens", "LIGAND"), donated("r_hydrogens", "RECEPTOR"))
    given = F.flatten(F.array_compact(sides))
    both = pairs.select(
        *pose,
        "ligand_atom",
        *["x", "y", "z"],
        F.col("r_receptor_atom").alias("receptor_atom"),
        *["r_x", "r_y", "r_z", "r_name", "r_structure"],
        F.inline(given),
    ).select("*", "h.*")
    bend = V.degrees(V.angle_at(V.vec(), V.vec("h_"), V.vec("r_")))
    return both.filter(F.abs(180 - bend) <= max_bend).select(
        *pose,
        "ligand_atom",
        "h_atom",
        "receptor_atom",
        "donor",
        side_of_chain(F.col("r_name")).alias("chain_side"),
        F.col("r_structure").alias("structure"),
        bend.alias("angle"),
    )


def hydrogen_bond_counts(bonds: DataFrame, pose: Sequence[str]) -> DataFrame:
    return bonds.groupBy(*pose, "donor", "chain_side", "structure").agg(
        F.count(F.lit(1)).alias("bonds")
    )
