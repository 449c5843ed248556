"""Missing scores are left out or last; NULL keys are a group of their own."""

import pytest
from pyspark.sql import functions as F

from dockspan.operators import consensus, features, graph, metrics, targets
from dockspan.operators.spatial import distance_join

NAN = float("nan")


def test_missing_scores_lose(spark):
    rows = [("t", "a", 1, NAN, 1), ("t", "a", 2, 0.9, 0), ("t", "b", 1, None, 0), ("t", "b", 2, NAN, 1), ("t", "c", 1, 0.2, 0)]
    df = spark.createDataFrame(rows, "target string, base string, place int, score double, label int")
    got = {r.base: (r.score, r.label) for r in metrics.collapse_poses(df, ["target"], "base", "score", "label", ["place"]).collect()}
    assert got == {"a": (0.9, 1), "b": (None, 0), "c": (0.2, 0)}


@pytest.mark.parametrize("gap", [NAN, None])
def test_missing_scores_are_the_last_level(spark, gap):
    rows = [("t", 0.9, 1), ("t", 0.8, 1), ("t", 0.1, 0), ("t", gap, 0), ("u", gap, 1), ("u", 0.5, 0), ("u", None, 0), ("u", NAN, 0)]
    df = spark.createDataFrame(rows, "target string, score double, label int")
    got = {r.target: (r.auc_roc, r.auc_pr) for r in metrics.ranking_areas(df, ["target"], "score", "label").collect()}
    assert got == {"t": (1.0, 1.0), "u": (pytest.approx(1 / 3), 0.25)}


def test_statistics_of_present_scores(spark):
    df = spark.createDataFrame([(0.2, 1), (0.6, 3), (NAN, 1), (None, 2)], "score double, total_poses int")
    stats = consensus.prediction_stats(df, "score").first()
    assert (stats.min_score, stats.max_score, stats.output_kind) == (0.2, 0.6, "probability")
    assert stats.mean_score == pytest.approx(0.4) and stats.std_score == pytest.approx(0.2)
    summary = consensus.result_summary(df).first()
    assert (summary.n_compounds, summary.max_score, summary.multi_pose_compounds) == (4, 0.6, 2)
    assert summary.mean_score == pytest.approx(0.4)


def molecule(key, shift):
    """A ring of six carbons with one oxygen; bonds 1.4 long."""
    ring = [(1.4, 0.0), (0.7, 1.2124), (-0.7, 1.2124), (-1.4, 0.0), (-0.7, -1.2124), (0.7, -1.2124)]
    return [(key, i, "C", x + shift, y, 0.0) for i, (x, y) in enumerate(ring)] + [(key, 6, "O", 2.8 + shift, 0.0, 0.0)]


def test_a_molecule_without_a_key(spark):
    atoms = spark.createDataFrame(molecule(None, 0.0) + molecule("m", 0.0), "mol string, idx int, element string, x double, y double, z double")
    bonds = graph.infer_bonds(atoms, ["mol"])
    assert sorted((r.mol is None, r.i, r.j) for r in bonds.collect() if r.mol is None) == [
        (True, i, j) for i, j in [(0, 1), (0, 5), (0, 6), (1, 2), (2, 3), (3, 4), (4, 5)]
    ]
    assert bonds.count() == 14
    counts = graph.neighbour_counts(atoms, bonds, ["mol"]).collect()
    assert len(counts) == 14 and {r.degree for r in counts if r.idx == 0} == {3}
    assert [sorted(r.members) for r in graph.enumerate_rings(bonds, ["mol"]).collect()] == [[0, 1, 2, 3, 4, 5]] * 2
    assert {(r.heavy_atoms, r.bonds, r.paths) for r in graph.path_counts(atoms, bonds, ["mol"]).collect()} == {(7, 7, 8)}


@pytest.mark.parametrize("limits", [{}, {"max_broadcast_rows": 0}, {"max_broadcast_rows": 0, "max_cell_pairs": 4}])
def test_distance_join_on_missing_keys(spark, limits):
    points = [(k, i, i * 0.3) for k in (None, "a") for i in range(12)]
    left = spark.createDataFrame([(k, i, x, 0.0, 0.0) for k, i, x in points], "g string, i int, x double, y double, z double")
    right = left.select("g", F.col("i").alias("r_i"), *[F.col(c).alias(f"r_{c}") for c in "xyz"])
    got = sorted((r.g is None, r.i, r.r_i) for r in distance_join(left, right, 1.0, ["g"], **limits).collect())
    assert got == sorted((k is None, i, j) for k, i, x in points for h, j, y in points if k == h and abs(x - y) < 1.0)


def test_a_missing_target_can_be_done(spark):
    found = spark.createDataFrame([(None,), ("a",), ("b",)], "target string")
    done = spark.createDataFrame([(None, 1), (None, 2), ("b", 3)], "target string, x int")
    assert [r.target for r in targets.not_done(found, done).collect()] == ["a"]
    got = {r.target: (r.n_rows, r.processed) for r in targets.coverage(found, done).collect()}
    assert got == {None: (2, True), "a": (0, False), "b": (1, True)}


def test_families_that_give_one_feature_add_up(spark):
    long = spark.createDataFrame([(1, "f", 1.0), (1, "f", 2.0), (1, "g", None), (2, None, None)], "id int, feature string, value double")
    got = [tuple(r) for r in features.to_wide(long, ["id"], ["f", "g"]).orderBy("id").collect()]
    assert got == [(1, 3.0, 0.0), (2, 0.0, 0.0)]
