"""Pairs within small groups, by one shuffle, against the distance join."""

import random

import pytest

from dockspan.operators.graph import infer_bonds
from dockspan.operators.spatial import distance_join, pairs_in_order, prefixed


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(8)
    rows = []
    for key in (None, "a", "b", "c"):
        for pose in (None, 1):
            # Numbers repeat, and some points have none or no place.
            rows += [
                (key, pose, rng.choice([None, *range(9)]), rng.choice("CNO"), rng.choice([None, *range(4)]), 0.5 * rng.randrange(6), 0.0)
                for _ in range(14)
            ]
    fields = "target string, pose int, i int, element string, x double, y double, z double"
    return spark.createDataFrame([(*r[:4], None if r[4] is None else float(r[4]), *r[5:]) for r in rows], fields).repartition(3)


def bag(df, columns):
    return sorted(df.select(*columns).collect(), key=str)


@pytest.mark.parametrize("limits", [{}, {"max_group_pairs": 1}, {"max_pairs_a_row": 0}])
def test_pairs_in_order_are_those_of_the_distance_join(points, limits):
    keys = ["target", "pose"]
    want = distance_join(points, prefixed(points, "r_", keys), 1.6, keys).filter("i < r_i")
    found = pairs_in_order(points, "i", 1.6, keys, **limits)
    assert sorted(found.columns) == sorted(want.columns)
    assert bag(found, want.columns) == bag(want, want.columns) and want.count()


def test_bonds_of_small_molecules_take_one_shuffle(points):
    atoms = points.withColumnRenamed("i", "idx").localCheckpoint()
    plan = infer_bonds(atoms, ["target", "pose"])._jdf.queryExecution().executedPlan().toString()
    # Only the table of lengths is joined.
    assert plan.count("Join") == 1 and plan.count("Exchange hashpartitioning") == 1
