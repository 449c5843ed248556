"""Interaction features of all poses of all targets, as one long table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from dockspan.operators import contacts
from dockspan.operators.contacts import TYPED_PAIR_REACH
from dockspan.operators.features import to_wide
from dockspan.operators.spatial import distance_join, prefixed
from dockspan.operators.typed_pairs import pair_name

def spaced_pair(head: str, pair: Column) -> Column:
    """Feature name of a sorted pair key: ``head (A, B)``."""
    return F.concat(F.lit(f"{head} ("), F.replace(pair, F.lit("_"), F.lit(", ")), F.lit(")"))


def pair_features(pairs: DataFrame, pose: Sequence[str], typed: bool = False) -> DataFrame:
    """Contact, energy, category and typed-pair features of atom pairs.

    ``pairs`` come from one distance join with the largest reach; a pair within
    4 adds to up to four contact features and, with ``typed``, one within 6
    whose atoms both have a type key adds to a typed-pair feature. All are
    added up in one aggregate, first within each task and then across tasks.
    """
    key = contacts.pair_key(F.col("atom_type"), F.col("r_atom_type"))
    near = F.col("dist") < contacts.CLOSE
    band = F.when(F.col("dist") < contacts.CLOSEST, spaced_pair("2.5", key)).otherwise(
        spaced_pair("4.0", key)
    )
    category = F.concat_ws(
        " ", F.col("r_structure"), contacts.side_of_chain(F.col("r_name"))
    )
    carbons = (F.col("element") == "C") & (F.col("r_element") == "C")

    def entry(name: Column, value: Column) -> Column:
        return F.struct(name.alias("feature"), value.alias("value"))

    one = F.lit(1.0)
    entries = [
        entry(F.when(near, band), one),
        entry(F.when(near, spaced_pair("ElSum", key)), contacts.coulomb()),
        entry(F.when(near, F.concat(F.lit("BPF "), category)), one),
        entry(F.when(near & carbons, F.concat(F.lit("HC "), category)), one),
    ]
    if typed:
        both = F.col("type_key").isNotNull() & F.col("r_type_key").isNotNull()
        entries.append(entry(F.when(both, pair_name(F.col("r_type_key"), F.col("type_key"))), one))
    return (
        pairs.select(*pose, F.inline(F.array(*entries)))
        .filter("feature is not null")
        .groupBy(*pose, "feature")
        .agg(F.sum("value").alias("value"))
    )


def interaction_features(
    ligands: DataFrame,
    receptors: DataFrame,
    pose: Sequence[str] = ("target", "pose"),
    keys: Sequence[str] = ("target",),
) -> DataFrame:
    """Pair features and ligand type flags of every pose, from one distance join.

    Atoms carry ``type_key``, NULL where the type is not counted.
    """
    pairs = distance_join(
        ligands, prefixed(receptors, "r_", keys), TYPED_PAIR_REACH, keys, inclusive=True
    )
    return pair_features(pairs, pose, typed=True).unionByName(type_features(ligands, pose))


def type_features(ligands: DataFrame, pose: Sequence[str], types=("N", "HD")) -> DataFrame:
    """Presence of ligand atom types: ``LA <type>`` is 1 or 0 for every pose."""
    flags = contacts.ligand_type_flags(ligands, pose, types)
    entries = F.array(
        *[
            F.struct(
                F.lit(f"LA {t}").alias("feature"),
                F.col(f"la_{t.lower()}").cast("double").alias("value"),
            )
            for t in types
        ]
    )
    return flags.select(*pose, F.inline(entries))


def bond_features(bonds: DataFrame, pose: Sequence[str]) -> DataFrame:
    """Hydrogen-bond features ``HB <structure> <chain side> <donor>``."""
    name = F.concat_ws(" ", F.lit("HB"), "structure", "chain_side", "donor")
    return bonds.groupBy(*pose, name.alias("feature")).agg(
        F.count(F.lit(1)).cast("double").alias("value")
    )


def value_features(values: DataFrame, pose: Sequence[str], names: Mapping[str, str]) -> DataFrame:
    """Columns of a table with one row per pose as long features under other names."""
    entries = [
        F.struct(F.lit(name).alias("feature"), F.col(c).cast("double").alias("value"))
        for c, name in names.items()
    ]
    return values.select(*pose, F.inline(F.array(*entries)))


def union_features(families: Sequence[DataFrame]) -> DataFrame:
    """All families of long features as one table."""
    return reduce(DataFrame.unionByName, families)


def feature_row(
    ligands: DataFrame, long: DataFrame, pose: Sequence[str], listed: Sequence[str]
) -> DataFrame:
    """The listed features of every pose in ``ligands``, 0 where a pose has none.

    ``long`` is the union of the families: :func:`interaction_features`,
    :func:`bond_features`, :func:`group_features` and :func:`value_features`
    for torsions and flexibility. ``listed`` usually is a feature list read with
    ``read_feature_lists``.
    """
    every = ligands.select(*pose).distinct().select(
        *pose, F.lit(None).cast("string").alias("feature"), F.lit(None).cast("double").alias("value")
    )
    return to_wide(every.unionByName(long), pose, listed)


# Feature names by kind of ring or charge contact.
KIND_NAMES = {
    "STACKING": ("piStack", ""),
    "T-SHAPED": ("tStack", ""),
    "LIGAND-CHARGED": ("catPi", " LIGAND"),
    "RECEPTOR-CHARGED": ("catPi", " RECEPTOR"),
    "SALT-BRIDGE": ("SB", ""),
}


def group_features(found: DataFrame, pose: Sequence[str], compat: bool = False) -> DataFrame:
    """Ring and charge contacts as features ``<name> <structure><suffix>``.

    ``compat`` leaves parallel stacking out, for models trained on tables
    where that feature was always empty.
    """
    kind = F.col("kind")
    head = F.coalesce(*[F.when(kind == k, F.lit(h)) for k, (h, _) in KIND_NAMES.items()])
    tail = F.coalesce(*[F.when(kind == k, F.lit(t)) for k, (_, t) in KIND_NAMES.items()])
    rows = found.filter(kind != "STACKING") if compat else found
    name = F.concat(head, F.lit(" "), F.col("structure"), tail)
    return rows.groupBy(*pose, name.alias("feature")).agg(
        F.count(F.lit(1)).cast("double").alias("value")
    )
