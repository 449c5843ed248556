"""Joins within small groups: one shuffle by key, without copies of points."""

import random

import pytest
from pyspark.sql import functions as F

from dockspan.operators.durable import stored
from dockspan.operators.spatial import distance_join, inside_box, prefixed

SCHEMA = "target string, id int, x double, y double, z double"


def groups(n, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", "c", None]), i, *(rng.uniform(0, 9) for _ in range(3))) for i in range(n)]
    return rows + [("alone", n, 0.0, 0.0, 0.0)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_small_groups_are_joined_without_copies(spark):
    left, right = (spark.createDataFrame(groups(n, n), SCHEMA) for n in (90, 140))
    right = prefixed(right, "r_", ["target"])
    whole = distance_join(left, right, 3.0, ["target"], max_broadcast_rows=0)
    cells = distance_join(left, right, 3.0, ["target"], max_broadcast_rows=0, max_pairs_a_row=0)
    assert "Generate" not in plan(whole) and "Generate" in plan(cells)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, cells.collect())) != []


@pytest.mark.parametrize("sizes", [(40, 150), (150, 40)])
def test_the_side_of_fewer_rows_is_copied(spark, sizes):
    left, right = (spark.createDataFrame(groups(n, n), SCHEMA) for n in sizes)
    right = prefixed(right, "r_", ["target"])
    found = distance_join(left, right, 3.0, ["target"], max_broadcast_rows=0, max_pairs_a_row=0)
    assert plan(found).count("Generate") == 1
    wanted = distance_join(left, right, 3.0, ["target"])
    assert sorted(map(repr, found.collect())) == sorted(map(repr, wanted.collect()))


def test_boxes_of_small_groups(spark):
    rows = [r for r in groups(200, 5) if r[0]]
    atoms = spark.createDataFrame(rows, SCHEMA)
    boxes = atoms.filter("id % 9 = 0").groupBy("target", (F.col("id") % 4).alias("pose")).agg(
        *[f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    )
    whole = inside_box(atoms, boxes, ["target"], 0.5)
    cells = inside_box(atoms, boxes, ["target"], 0.5, max_pairs_a_row=0)
    assert "Generate" not in plan(whole)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, cells.collect())) != []


def test_stored_rows_are_compressed(spark):
    rows = spark.range(50000).select(F.lit("the same words").alias("w"), (F.col("id") % 7).alias("n"))
    kept = stored(rows, "rows")
    size = sum(spark._jvm.java.io.File(f.removeprefix("file:")).length() for f in kept.inputFiles())
    assert kept.count() == 50000 and size < 300000
