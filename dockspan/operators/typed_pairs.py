"""Counts of atom-type pairs between a receptor and a pose."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dockspan.functions.fixed_values import COUNTED_LIGAND_TYPES, LIGAND_TYPE_KEYS, PROTEIN_TYPE_KEYS
from dockspan.operators.contacts import TYPED_PAIR_REACH
from dockspan.operators.sizing import small
from dockspan.operators.spatial import distance_join, prefixed


def is_heavy_name(name: Column) -> Column:
    """Protein atom name that is not a hydrogen's.

    Names of up to three characters start with another letter than H; names of
    four have no H in the first two places.
    """
    bare = F.replace(name, F.lit(" "), F.lit(""))
    first, second = F.substring(bare, 1, 1), F.substring(bare, 2, 1)
    return ((F.length(bare) < 4) & (first != "H")) | (
        (F.length(bare) == 4) & (first != "H") & (second != "H")
    )


def receptor_types(
    receptors: DataFrame, atom_keys: DataFrame, resname: str = "resname", name: str = "name"
) -> DataFrame:
    """Heavy receptor atoms with their type key; atoms without one are dropped.

    The key table has one row per residue-atom name of the amino acids.
    """
    return with_receptor_types(receptors, atom_keys, resname, name).filter("type_key is not null")


def with_receptor_types(
    receptors: DataFrame, atom_keys: DataFrame, resname: str = "resname", name: str = "name"
) -> DataFrame:
    """All receptor atoms, with a type key where they have one."""
    pdb_atom = F.when(is_heavy_name(F.col(name)), F.concat_ws("-", F.col(resname), F.col(name)))
    named = receptors.withColumn("pdb_atom", pdb_atom)
    return named.join(small(atom_keys), "pdb_atom", "left").drop("pdb_atom")


def typed_pairs(
    ligands: DataFrame,
    receptors: DataFrame,
    keys: Sequence[str] = ("target",),
    radius: float = TYPED_PAIR_REACH,
    protein_types: Sequence[str] = PROTEIN_TYPE_KEYS,
    ligand_types: Sequence[str] = COUNTED_LIGAND_TYPES,
) -> DataFrame:
    """Atom pairs of known types at most ``radius`` apart.

    Ligand types outside the counted pairs are left out; pass LIGAND_TYPE_KEYS to count all.
    """
    known_ligands = ligands.filter(F.col("type_key").isin(list(ligand_types)))
    known_receptors = receptors.filter(F.col("type_key").isin(list(protein_types)))
    return distance_join(
        known_ligands, prefixed(known_receptors, "r_", keys), radius, keys, inclusive=True
    )


def pair_name(protein_type: Column, ligand_type: Column) -> Column:
    """Feature name of a type pair: both keys without ``;``, joined by ``-``."""
    return F.replace(F.concat_ws("-", protein_type, ligand_type), F.lit(";"), F.lit(""))


def typed_pair_counts(pairs: DataFrame, pose: Sequence[str]) -> DataFrame:
    """Long counts ``(pose, feature, value)`` of the pairs that occur."""
    return pairs.groupBy(
        *pose, pair_name(F.col("r_type_key"), F.col("type_key")).alias("feature")
    ).agg(F.count(F.lit(1)).cast("double").alias("value"))


def pair_domain(spark) -> DataFrame:
    """All combinations of the protein and ligand type keys, in list order."""
    keys = F.array(*[F.lit(k) for k in PROTEIN_TYPE_KEYS])
    partners = F.array(*[F.lit(k) for k in LIGAND_TYPE_KEYS])
    return (
        spark.range(1)
        .select(F.posexplode(keys).alias("i", "protein_type"))
        .select("i", "protein_type", F.posexplode(partners).alias("j", "ligand_type"))
        .select(
            (F.col("i") * len(LIGAND_TYPE_KEYS) + F.col("j")).alias("ord"),
            "protein_type",
            "ligand_type",
            pair_name(F.col("protein_type"), F.col("ligand_type")).alias("feature"),
        )
    )


def unknown_types(atoms: DataFrame, known: Sequence[str], column: str = "type_key") -> DataFrame:
    """Distinct types that are not in the known list."""
    return atoms.filter(~F.col(column).isin(list(known))).select(column).distinct()
