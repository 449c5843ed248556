"""Missing values, NULL keys and inputs beyond the usual sizes."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dockspan.operators import attribution, consensus, features, metrics, ordering, residues, scaling, spatial, targets
from dockspan.operators.forest import NODE_SCHEMA, load_forest, margins, score_forest
from dockspan.operators.joins import join_same
from dockspan.operators.sizing import attach, fits_broadcast
from dockspan.sources import structures
from dockspan.streaming.ingest import running_best

NAN = float("nan")
SCORES = [("t", "a_out_pose1", None), ("t", "a_out_pose2", 0.9), ("t", "a_out_pose3", NAN), ("t", "b_out_pose1", None)]


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame(SCORES, "target string, compound_id string, score double")


def test_missing_scores_rank_last(scores):
    ranks = {r.compound_id: r["rank"] for r in consensus.rank_by_score(scores).collect()}
    assert ranks["a_out_pose2"] == 1
    assert [r.compound_id for r in consensus.top_scores(scores, 1).collect()] == ["a_out_pose2"]


def test_missing_scores_lose_best_pose(scores):
    for found in (consensus.best_pose(scores), running_best(scores)):
        best = {r.base_compound: r.score for r in found.collect()}
        assert sorted(map(str, best.values())) == ["0.9", "None"]


def test_nan_is_filled_before_scaling(spark):
    rows = spark.createDataFrame([(1, NAN), (2, None), (3, 4.0)], "id int, f double")
    for fill, missing in (("before", -0.5), ("after", 0.0)):
        found = scaling.apply_scaler(rows, {"f": (1.0, 2.0)}, ["id"], fill).orderBy("id").collect()
        assert [r.f for r in found] == [missing, missing, 1.5]


def test_scaler_of_too_many_rows(spark):
    rows = spark.range(5).selectExpr("cast(id as string) feature", "id ord", "0.0D offset", "1.0D scale")
    with pytest.raises(ValueError):
        scaling.read_params(rows, max_features=4)
    assert len(scaling.read_params(rows)) == 5


def test_every_pose_keeps_its_row(spark):
    long = spark.createDataFrame([("p", "a", 1.0), ("q", "other", 2.0)], "pose string, feature string, value double")
    rows = {r.pose: (r.a, r["b.c"]) for r in features.to_wide(long, ["pose"], ["a", "b.c"]).collect()}
    assert rows == {"p": (1.0, 0.0), "q": (0.0, 0.0)}


def test_null_groups_are_groups(spark):
    rows = spark.createDataFrame([(None, 1, 5), (None, 2, 5), ("g", 1, 6)], "grp string, pos long, v long")
    runs = residues.number_runs(rows, ["grp"], "pos", ["v"]).collect()
    assert len(runs) == 3 and {r.run for r in runs} == {1}
    summed = ordering.running_by_position(rows, ["grp"], "pos", F.col("v"), "s", block_rows=1)
    assert sorted(r.s for r in summed.collect()) == [5, 6, 10]
    lookup = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(r.n for r in attach(rows, lookup, ["grp"]).collect()) == [1, 2, 2]
    assert join_same(rows, lookup, ["grp"], "left_anti").count() == 0


def test_metrics_of_a_null_target(spark):
    rows = [(None, i, float(i), i % 2) for i in range(6)] + [("t", i, float(i), 1) for i in range(3)]
    frame = spark.createDataFrame(rows, "target string, id int, score double, label int")
    found = metrics.screening_metrics(frame, ["target"], "score", "label", ["id"]).collect()
    assert {r.target for r in found} == {None, "t"}


def test_first_protein_file_of_a_target(spark):
    paths = ["/d/protein/t_b.pdbqt", "/d/protein/t_a.pdbqt", "/d/molecule/t/x.pdbqt", "/d/molecule/t/y.pdbqt"]
    found = structures.discover_targets(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert sorted((r.protein_path, r.ligand_path) for r in found) == [(paths[1], paths[2]), (paths[1], paths[3])]


def test_compound_checks(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "compound_id string, f double")
    found = targets.filter_compound(rows, "a")
    assert targets.require_compound(found, "a", features=1).count() == 1
    with pytest.raises(ValueError):
        targets.require_compound(targets.filter_compound(rows, "c"), "c")
    with pytest.raises(ValueError):
        targets.require_compound(found, "a", features=2)


def test_byte_check_counts_wide_rows(spark):
    rows = spark.range(10).withColumn("points", F.array_repeat(F.lit(1.0), 1000))
    assert fits_broadcast(rows, max_bytes=1 << 20) and not fits_broadcast(rows, max_bytes=1 << 18)
    assert not fits_broadcast(spark.range(10), max_rows=9)


def brute_pairs(left, right, radius):
    return {(a, b) for a, *p in left for b, *q in right if math.dist(p, q) < radius}


@pytest.mark.parametrize("limits", [{}, {"max_broadcast_rows": 0}, {"max_broadcast_rows": 0, "max_cell_pairs": 4}])
def test_distance_join_against_all_pairs(spark, limits):
    rng = np.random.default_rng(11)
    points = rng.uniform(-3, 3, (60, 3)).tolist() + [[-2.0, 0.0, 2.0], [0.0, 0.0, 0.0], [4.0, -4.0, 0.0], [-1e-9, 0.0, 2.0]]
    left = [(i, *p) for i, p in enumerate(points)]
    crowd = [(100 + i, *rng.uniform(-0.2, 0.2, 3).tolist()) for i in range(30)] + [(200, 2.0, 0.0, 0.0), (200, 2.0, 0.0, 0.0)]
    schema = "id int, x double, y double, z double"
    right = spatial.prefixed(spark.createDataFrame(crowd, schema), "r_")
    found = spatial.distance_join(spark.createDataFrame(left, schema), right, 1.0, **limits).collect()
    assert {(r.id, r.r_id) for r in found} == brute_pairs(left, crowd, 1.0)
    assert len(found) == sum(math.dist(p, q) < 1.0 for _, *p in left for _, *q in crowd)


def test_one_row_against_a_full_cell(spark):
    schema = "id int, x double, y double, z double"
    one = spark.createDataFrame([(0, 0.1, 0.1, 0.1)], schema)
    many = spark.createDataFrame([(i, 0.1, 0.1, 0.1 + i * 1e-4) for i in range(200)], schema)
    for left, right in ((one, many), (many, one)):
        found = spatial.distance_join(left, spatial.prefixed(right, "r_"), 1.0, max_broadcast_rows=0, max_cell_pairs=10)
        assert found.count() == 200


def test_boxes_of_very_different_sizes(spark):
    atoms = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(-50, 50)], "id int, x double, y double, z double")
    limits = [(0, -3.0, 3.0), (1, -1e9, 1e9), (2, 10.0, 10.0), (3, 5.0, -5.0)]
    boxes = spark.createDataFrame(
        [(b, lo, hi, -1.0, 1.0, -1.0, 1.0) for b, lo, hi in limits],
        "box int, min_x double, max_x double, min_y double, max_y double, min_z double, max_z double",
    )
    found = spatial.inside_box(atoms, boxes, [], 0.5).groupBy("box").count().collect()
    assert {r.box: r["count"] for r in found} == {0: 7, 1: 100, 2: 1}


def generated(trees, depth, seed=0):
    rng = np.random.default_rng(seed)
    inner = 2**depth - 1
    rows = []
    for t in range(trees):
        for n in range(inner):
            side = int(rng.integers(0, 2))
            rows.append((t, n, f"f{rng.integers(0, 5)}", float(rng.random()), 2 * n + 1, 2 * n + 2, 2 * n + 1 + side, None, float(2 ** (depth - int(math.log2(n + 1))))))
        rows += [(t, n, None, None, None, None, None, float(rng.normal()), 1.0) for n in range(inner, 2 * inner + 1)]
    return rows


def test_expression_parts_and_batches_agree(spark):
    nodes = spark.createDataFrame(generated(6, 3), NODE_SCHEMA)
    rng = np.random.default_rng(1)
    data = [[None if rng.random() < 0.1 else NAN if rng.random() < 0.1 else float(rng.random()) for _ in range(5)] for _ in range(60)]
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "id int, f0 double, f1 double, f2 double, f3 double, f4 double")
    whole = load_forest(nodes)
    matrix = np.array([[NAN if v is None else v for v in r] for r in data], np.float32)
    expected = margins(whole, matrix[:, [int(f[1]) for f in whole.features]], 0.5)
    for options in ({"max_expression_nodes": 1000}, {"max_expression_nodes": 0}, {"max_expression_nodes": 0, "part_nodes": 20}):
        found = score_forest(rows, nodes, base_margin=0.5, logistic=False, **options).orderBy("id").collect()
        assert np.allclose([r.prediction for r in found], expected)
    one = attribution.attribute(rows, nodes, ["id"]).groupBy("id", "feature").agg(F.sum("value").alias("v"))
    parts = attribution.row_attributions(rows, nodes, ["id"], part_nodes=20).select("id", F.inline("values"))
    both = one.join(parts, ["id", "feature"]).collect()
    assert len(both) == 300 and all(math.isclose(r.v, r.value, abs_tol=1e-9) for r in both)
    total = {r.id: r.v for r in one.groupBy("id").agg(F.sum("v").alias("v")).collect()}
    mean = attribution.expected_margin(whole)
    assert np.allclose([total[i] + mean for i in range(60)], np.array(expected) - 0.5)


def test_expression_size_grows_with_the_nodes(spark):
    nodes = spark.createDataFrame(generated(1, 7), NODE_SCHEMA)
    rows = spark.range(2000).selectExpr("id", *[f"rand({i}) f{i}" for i in range(5)])
    scored = score_forest(rows, nodes, max_expression_nodes=1000)
    assert len(scored._jdf.queryExecution().analyzed().toString()) < 200_000
    assert isinstance(scored.agg(F.sum("prediction")).toPandas(), pd.DataFrame)


def test_pruning_settles_groups_apart(spark):
    rows = [("a", i, i, "A", i * 3.4, 0.0, 0.0, "ALPHA") for i in range(40)] + [("b", i, i, "A", i * 90.0, 0.0, 0.0, "BETA") for i in range(5)]
    rows += [(None, i, i, "A", i * 90.0, 0.0, 0.0, "BETA") for i in range(5)]
    frame = spark.createDataFrame(rows, "grp string, position long, resid int, chain string, x double, y double, z double, class string")
    found = residues.prune_runs(frame, ["grp"]).collect()
    assert len(found) == 50
    assert {r["class"] for r in found} == {"OTHER"}
