import math
import random

import pytest
from pyspark.sql import functions as F

from dockspan.functions import vectors as V
from dockspan.operators.spatial import bounding_box, distance_join, inside_box, prefixed


def cloud(n, seed, spread=12.0):
    rng = random.Random(seed)
    # A third of the points crowd into one spot of one target.
    out = []
    for i in range(n):
        if i % 3 == 0:
            out.append(("hot", i, *(rng.uniform(-0.5, 0.5) for _ in range(3))))
        else:
            out.append((rng.choice(["a", "hot"]), i, *(rng.uniform(-spread, spread) for _ in range(3))))
    return out


SCHEMA = "target string, id int, x double, y double, z double"


def brute(left, right, radius, inclusive):
    near = set()
    for lt, li, *p in left:
        for rt, ri, *q in right:
            d = math.sqrt(sum((a - b) ** 2 for a, b in zip(p, q)))
            if lt == rt and (d <= radius if inclusive else d < radius):
                near.add((li, ri))
    return near


@pytest.mark.parametrize("radius", [0.7, 2.5, 6.0])
@pytest.mark.parametrize(
    "limits",
    [{}, {"max_broadcast_rows": 0}, {"max_broadcast_rows": 0, "max_cell_pairs": 50}],
    ids=["broadcast", "shuffled", "crowded"],
)
def test_equals_brute_force(spark, radius, limits):
    left, right = cloud(150, 1), cloud(220, 2)
    found = distance_join(
        spark.createDataFrame(left, SCHEMA),
        prefixed(spark.createDataFrame(right, SCHEMA), "r_", ["target"]),
        radius,
        ["target"],
        **limits,
    )
    pairs = [(r.id, r.r_id) for r in found.collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == brute(left, right, radius, False)


@pytest.mark.parametrize("inclusive", [True, False])
def test_points_exactly_at_the_radius(spark, inclusive):
    left = [("a", 1, 0.0, 0.0, 0.0), ("a", 2, -8.0, 4.0, 0.0)]
    right = [("a", 1, 4.0, 0.0, 0.0), ("a", 2, -8.0, 8.0, 0.0), ("a", 3, -4.0, 0.0, 0.0)]
    found = distance_join(
        spark.createDataFrame(left, SCHEMA),
        prefixed(spark.createDataFrame(right, SCHEMA), "r_", ["target"]),
        4.0,
        ["target"],
        inclusive=inclusive,
    )
    assert {(r.id, r.r_id) for r in found.collect()} == brute(left, right, 4.0, inclusive)


def test_shifting_both_sides_changes_nothing(spark):
    left, right = cloud(80, 3), cloud(80, 4)

    def pairs(offset):
        moved = [[(t, i, x + offset, y - offset, z) for t, i, x, y, z in side] for side in (left, right)]
        a, b = (spark.createDataFrame(side, SCHEMA) for side in moved)
        found = distance_join(a, prefixed(b, "r_", ["target"]), 3.0, ["target"])
        return {(r.id, r.r_id) for r in found.collect()}

    assert pairs(0.0) == pairs(1024.0)


def test_box_holds_what_lies_inside(spark):
    ligand, receptor = cloud(20, 5, 4.0), cloud(300, 6, 30.0)
    boxes = bounding_box(spark.createDataFrame(ligand, SCHEMA), ["target"])
    got = {r.id for r in inside_box(spark.createDataFrame(receptor, SCHEMA), boxes, ["target"], 2.0).collect()}
    want = set()
    for target in ("a", "hot"):
        mine = [p for t, _, *p in ligand if t == target]
        low = [min(p[k] for p in mine) - 2 for k in range(3)]
        high = [max(p[k] for p in mine) + 2 for k in range(3)]
        want |= {
            i for t, i, *p in receptor if t == target and all(l < v < h for l, v, h in zip(low, p, high))
        }
    assert got == want


def test_vector_functions(spark):
    def value(column):
        return spark.range(1).select(column.alias("v")).first().v

    def point(*xyz):
        return tuple(F.lit(float(v)) for v in xyz)

    assert value(V.distance(point(0, 0, 0), point(3, 4, 0))) == 5.0
    assert value(V.normalize(point(0, 0, 0))[0]) is None
    right = V.degrees(V.angle_at(point(1, 0, 0), point(0, 0, 0), point(0, 2, 0)))
    assert value(right) == pytest.approx(90)
    turn = V.dihedral(point(1, 0, 0), point(0, 0, 0), point(0, 0, 1), point(0, 1, 1))
    assert abs(math.degrees(value(turn))) == pytest.approx(90)
    straight = V.dihedral(point(1, 0, 0), point(0, 0, 0), point(0, 0, 1), point(-1, 0, 1))
    assert abs(math.degrees(value(straight))) == pytest.approx(180)
    foot = V.project(point(3, 4, 9), tuple(F.lit(v) for v in (0.0, 0.0, 2.0, 4.0)))
    assert [value(c) for c in foot] == [3.0, 4.0, 2.0]
