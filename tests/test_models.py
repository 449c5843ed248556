import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dockspan.operators import attribution, features, scaling
from dockspan.operators.forest import Forest, NODE_SCHEMA, batch_margins, goes_to, load_forest, margins, masked_trees, score_forest
from dockspan.plans.rescoring import best_poses, rescore

NODES = [
    (0, 0, "a", 0.5, 1, 2, 2, None, 10.0),
    (0, 1, "b", 0.5, 3, 4, 3, None, 6.0),
    (0, 2, "a", 0.8, 5, 6, 6, None, 4.0),
    (0, 3, None, None, None, None, None, 1.0, 2.0),
    (0, 4, "c", 0.2, 7, 8, 8, None, 4.0),
    (0, 5, None, None, None, None, None, -2.0, 1.0),
    (0, 6, None, None, None, None, None, 0.5, 3.0),
    (0, 7, None, None, None, None, None, 3.0, 1.0),
    (0, 8, None, None, None, None, None, -1.0, 3.0),
    (1, 0, None, None, None, None, None, 0.25, 10.0),
]
GRID = [None, 0.1, 0.5, 0.6, 0.9]
ROWS = [(i, *v) for i, v in enumerate(itertools.product(GRID, repeat=3))]


@pytest.fixture(scope="module")
def forest(spark):
    return load_forest(spark.createDataFrame(NODES, NODE_SCHEMA))


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id int, a double, b double, c double")


def margin(row, known=None, at=0):
    """Expected margin of tree 0 when only the known features are used."""
    _, _, feature, limit, yes, no, missing, leaf, cover = NODES[at]
    if leaf is not None:
        return leaf
    if known is None or feature in known:
        value = row[feature]
        if value is None:
            return margin(row, known, missing)
        return margin(row, known, yes if np.float32(value) < np.float32(limit) else no)
    return sum(NODES[c][8] / cover * margin(row, known, c) for c in (yes, no))


def test_expression_and_batches_agree(spark, rows, forest):
    small = score_forest(rows, forest, "p", logistic=False)
    large = score_forest(rows, forest, "p", logistic=False, max_expression_nodes=0)
    a, b = ({r.id: r.p for r in df.collect()} for df in (small, large))
    for i, *v in ROWS:
        want = margin(dict(zip("abc", v))) + 0.25
        assert a[i] == pytest.approx(want) and b[i] == pytest.approx(want)


def test_attributions_are_shapley_values(spark, rows, forest):
    got = {}
    for r in attribution.attribute(rows, forest, ["id"]).collect():
        got.setdefault(r.id, {})[r.feature] = r.value
    for i, *v in ROWS:
        row = dict(zip("abc", v))
        for f in "abc":
            rest = [g for g in "abc" if g != f]
            want = 0.0
            for k in range(3):
                weight = math.factorial(k) * math.factorial(2 - k) / 6
                for known in itertools.combinations(rest, k):
                    want += weight * (margin(row, {*known, f}) - margin(row, set(known)))
            assert got[i][f] == pytest.approx(want)
        total = sum(got[i].values()) + attribution.expected_margin(forest)
        assert total == pytest.approx(margin(row) + 0.25)


def test_top_and_rest(spark):
    long = spark.createDataFrame(
        [(1, "a", 0.5), (1, "b", -2.0), (1, "c", 0.1), (1, "d", 0.2)], "id int, feature string, value double"
    )
    arrays = long.groupBy("id").agg(F.collect_list(F.struct("feature", "value")).alias("values"))
    assert attribution.top_and_rest(arrays, ["id"], 9).count() == 4
    got = {r.feature: (r.value, r.n_features) for r in attribution.top_and_rest(arrays, ["id"], 3).collect()}
    assert got == {"b": (-2.0, 1), "a": (0.5, 1), "rest": (pytest.approx(0.3), 2)}
    ranking = attribution.rank_features(long, top=2).collect()
    assert [r.feature for r in ranking] == ["b", "a"]


def test_scalers(spark):
    df = spark.createDataFrame(
        [(1.0, 5.0), (3.0, 5.0), (None, 5.0), (float("nan"), 5.0)], "u double, k double"
    )
    fits = {k: scaling.read_params(scaling.fit_scaler(df, ["u", "k"], k)) for k in scaling.KINDS}
    assert fits["standard"] == {"u": (2.0, 1.0), "k": (5.0, 1.0)}
    assert fits["minmax"] == {"u": (1.0, 2.0), "k": (5.0, 1.0)}
    assert fits["maxabs"] == {"u": (0.0, 3.0), "k": (0.0, 5.0)}
    params = {"u": (2.0, 4.0), "gone": (1.0, 2.0)}
    one = spark.createDataFrame([(7, None, 1.0)], "id int, u double, k double")
    before = scaling.apply_scaler(one, params, ["id"], "before").first()
    after = scaling.apply_scaler(one, params, ["id"], "after").first()
    assert tuple(before) == (7, -0.5, -0.5) and tuple(after) == (7, 0.0, -0.5)
    with pytest.raises(ValueError):
        scaling.fit_scaler(df, ["u"], "robust")


def test_feature_tables(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, float("nan"), 3.0)], "id int, b double, a double")
    filled = features.fill_missing(df, ["a", "b"])
    assert [r.b for r in filled.orderBy("id").collect()] == [0.0, 0.0]
    aligned = features.align(filled, ["b", "z", "a"], ["id"], drop=["a"])
    assert aligned.columns == ["id", "b", "z"]
    assert features.align(filled, None, ["id"]).columns == ["id", "a", "b"]
    kept, missing = features.prune(df, ["a", "q"], ["id"])
    assert kept.columns == ["id", "a"] and missing == ["q"]
    wide = features.to_wide(features.to_long(filled, ["id"], ["a", "b"]), ["id"], ["b", "a", "n"])
    assert [tuple(r) for r in wide.orderBy("id").collect()] == [(1, 0.0, 2.0, 0.0), (2, 0.0, 3.0, 0.0)]


def test_rescoring_in_one_plan(spark, forest):
    data = [
        ("t1", "m_pose1.pdbqt", 0.1, 0.1, 0.1),
        ("t1", "m_pose2.pdbqt", 0.9, 0.1, 0.1),
        ("t1", "n", 0.6, 0.9, 0.1),
        ("t2", "n", 0.1, 0.9, 0.1),
    ]
    df = spark.createDataFrame(data, "target string, compound_id string, a double, b double, c double")
    unit = {f: (0.0, 1.0) for f in "abc"}
    ranked = rescore(df, ["target", "compound_id"], {"ps": unit, "pb": unit}, {"ps": forest, "pb": forest})
    got = {(r.target, r.compound_id): r for r in ranked.collect()}
    assert sorted(r["rank"] for r in got.values() if r.target == "t1") == [1, 2, 3]
    assert all(r.score == pytest.approx(r.ps) for r in got.values())
    best = {(r.target, r.base_compound): r for r in best_poses(ranked).collect()}
    assert best[("t1", "m")].total_poses == 2
    assert best[("t1", "m")].selected_pose == "pose1.pdbqt"
    assert best[("t1", "n")].selected_pose == "original"
    renumbered = best_poses(ranked, rank_scope="compound")
    assert sorted(r["rank"] for r in renumbered.filter("target = 't1'").collect()) == [1, 2]
    with pytest.raises(ValueError):
        rescore(df, ["target", "compound_id"], {"ps": unit, "pb": unit}, {"ps": forest, "pb": forest}, (0.5, 0.6))


def random_forest(trees, depth, count, seed, grown=1.0):
    """A forest as arrays: ``grown`` is the chance that a node above ``depth`` is split."""
    rng = np.random.default_rng(seed)
    nodes = []

    def make(depth, cover):
        at = len(nodes)
        nodes.append([-1, np.nan, -1, -1, -1, rng.normal(), cover])
        if depth and rng.random() <= grown:
            share = rng.uniform(0.2, 0.8)
            yes, no = make(depth - 1, cover * share), make(depth - 1, cover * (1 - share))
            nodes[at] = [rng.integers(count), rng.random(), yes, no, rng.choice([yes, no]), np.nan, cover]
        return at

    roots = [make(depth, 100.0) for _ in range(trees)]
    feature, threshold, yes, no, missing, leaf, cover = (np.array(c) for c in zip(*nodes))
    whole = [x.astype(np.int64) for x in (feature, yes, no, missing)]
    names = [f"f{i:03d}" for i in range(count)]
    return Forest(names, np.array(roots), whole[0], threshold.astype(np.float32), *whole[1:], leaf, cover)


def random_rows(rows, count, seed, missing=0.2):
    rng = np.random.default_rng(seed)
    matrix = rng.random((rows, count), dtype=np.float32)
    matrix[rng.random(matrix.shape) < missing] = np.nan
    return matrix


def brute_shapley(forest, matrix):
    """Sum over all sets of known features, leaf by leaf."""
    out = np.zeros(matrix.shape)
    for leaf, path in attribution.leaf_paths(forest):
        size = len(path)
        follows = [
            np.logical_and.reduce([goes_to(forest, np.full(len(matrix), n), matrix[:, forest.feature[n]]) == c for n, c in steps])
            for _, steps, _ in path
        ]
        for i, (feature, _, share) in enumerate(path):
            rest = [j for j in range(size) if j != i]
            for k in range(size):
                weight = math.factorial(k) * math.factorial(size - k - 1) / math.factorial(size)
                for known in itertools.combinations(rest, k):
                    value = np.full(len(matrix), weight * leaf)
                    for j in rest:
                        value = value * (follows[j] if j in known else path[j][2])
                    out[:, feature] += value * (follows[i] - share)
    return out


@pytest.mark.parametrize("depth, count, grown", [(4, 4, 1.0), (5, 20, 0.8), (3, 2, 1.0), (1, 3, 1.0), (0, 1, 1.0)])
@pytest.mark.parametrize("subtree, leaf, values", [(7, 10, 1 << 25), (2, 3, 100), (0, 1, 1), (7, 2, 1 << 25)])
def test_pattern_tables_give_shapley_values(monkeypatch, depth, count, grown, subtree, leaf, values):
    monkeypatch.setattr(attribution, "SUBTREE_BITS", subtree)
    monkeypatch.setattr(attribution, "LEAF_BITS", leaf)
    forest, matrix = random_forest(4, depth, count, depth, grown), random_rows(37, count, 1)
    plans = list(attribution.PlanBuilder(forest, values).plans())
    got = attribution.shapley_values(plans, matrix)
    assert np.allclose(got, brute_shapley(forest, matrix), atol=1e-12)
    assert np.allclose(got.sum(axis=1) + attribution.expected_margin(forest), margins(forest, matrix, 0.0))


def test_tables_follow_the_leaves_and_not_the_features():
    sizes = []
    for count in (50, 500):
        plans = list(attribution.PlanBuilder(random_forest(40, 6, count, 3)).plans())
        sizes.append(sum(t.nbytes for p in plans for t in p.tables.values()))
    assert sizes[1] < 1.2 * sizes[0] and sizes[1] < 2500 * 40 * 64


@pytest.mark.parametrize(
    "trees, depth, count, grown", [(1000, 4, 30, 0.9), (30, 7, 5, 1.0), (3, 11, 8, 1.0), (5, 3, 200, 1.0), (4, 0, 1, 1.0), (90, 6, 2, 1.0)]
)
def test_masks_reach_the_same_leaves(trees, depth, count, grown):
    forest, matrix = random_forest(trees, depth, count, 5, grown), random_rows(300, count, 2)
    matrix[:40] = np.where(np.arange(count) % 2, np.nan, matrix[:40])
    # Values that equal a limit belong to the no side.
    inner = np.flatnonzero(forest.feature >= 0)[:200]
    matrix[np.arange(len(inner)), forest.feature[inner]] = forest.threshold[inner]
    groups, walked = masked_trees(forest, 20_000)
    assert (len(walked) > 0) == (depth > 10) and (walked or len(groups) > (trees > 900))
    assert np.allclose(batch_margins(forest, groups, walked, matrix), margins(forest, matrix, 0.0))


def test_a_third_way_for_missing_values_is_walked():
    forest = random_forest(2, 2, 3, 1)
    forest.missing[forest.roots[0]] = forest.yes[forest.yes[forest.roots[0]]]
    matrix = random_rows(50, 3, 3)
    groups, walked = masked_trees(forest)
    assert walked == [forest.roots[0]]
    assert np.allclose(batch_margins(forest, groups, walked, matrix), margins(forest, matrix, 0.0))


def test_parts_and_plans_add_up(spark, rows):
    nodes = spark.createDataFrame([(t, *n[1:]) for t in range(7) for n in NODES if n[0] == 0], NODE_SCHEMA)
    one = attribution.row_attributions(rows, nodes, ["id"]).collect()
    many = attribution.row_attributions(rows, nodes, ["id"], part_nodes=10, table_values=1).collect()
    got = {r.id: [(v.feature, pytest.approx(v.value)) for v in r["values"]] for r in one}
    assert {r.id: [(v.feature, v.value) for v in r["values"]] for r in many} == got
    assert attribution.row_attributions(rows.limit(0), nodes, ["id"]).collect() == []


def test_a_forest_of_leaves_has_no_attributions(spark, rows):
    nodes = spark.createDataFrame([n for n in NODES if n[0] == 1], NODE_SCHEMA)
    assert [r["values"] for r in attribution.row_attributions(rows, nodes, ["id"]).limit(2).collect()] == [[], []]
    scored = score_forest(rows, nodes, "p", logistic=False, max_expression_nodes=0)
    assert {r.p for r in scored.collect()} == {0.25}


def test_missing_child_is_an_error(spark):
    with pytest.raises(ValueError):
        load_forest(spark.createDataFrame([NODES[0], NODES[3]], NODE_SCHEMA))
