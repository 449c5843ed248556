import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dockspan.operators import correlation, metrics
from dockspan.plans.evaluation import evaluate_screening

LIMITS = [{}, {"max_group_rows": 0}]


def screen(seed=7, n=400):
    rng = random.Random(seed)
    return [
        (rng.choice(["a", "b", "b", "b"]), i, int(rng.random() < 0.2), round(rng.random(), 2))
        for i in range(n)
    ]


def expected(rows):
    ordered = sorted(rows, key=lambda r: (-r[3], r[1]))
    n, hits = len(ordered), sum(r[2] for r in ordered)
    ef = {}
    for name, f in metrics.FRACTIONS.items():
        k = math.ceil(n * f)
        ef[name] = sum(r[2] for r in ordered[:k]) / k / (hits / n)
    a, ra = 80.5, hits / n
    rie = sum(math.exp(-a * i / n) for i, r in enumerate(ordered, 1) if r[2]) / (
        hits * (1 - math.exp(-a)) / (n * (math.exp(a / n) - 1))
    )
    top = (1 - math.exp(-a * ra)) / (ra * (1 - math.exp(-a)))
    low = (1 - math.exp(a * ra)) / (ra * (1 - math.exp(a)))
    pairs = [(p[3], q[3]) for p in rows if p[2] for q in rows if not q[2]]
    auc = sum((p > q) + (p == q) / 2 for p, q in pairs) / len(pairs)
    precision = 0.0
    for level in sorted({r[3] for r in rows}, reverse=True):
        above = [r for r in rows if r[3] >= level]
        here = sum(r[2] for r in rows if r[3] == level)
        precision += here * sum(r[2] for r in above) / len(above)
    return {**ef, "bedroc": (rie - low) / (top - low), "auc_roc": auc, "auc_pr": precision / hits}


@pytest.mark.parametrize("limits", LIMITS, ids=["window", "sliced"])
def test_screening_metrics(spark, limits):
    rows = screen()
    df = spark.createDataFrame(rows, "target string, id int, label int, score double")
    got = metrics.screening_metrics(df, ["target"], "score", "label", ["id"], **limits)
    for row in got.collect():
        want = expected([r for r in rows if r[0] == row.target])
        for name, value in want.items():
            assert row[name] == pytest.approx(value), name


def test_one_class_and_tiny_groups(spark):
    rows = [("none", 1, 0, 0.5), ("none", 2, 0, 0.4), ("all", 1, 1, 0.5), ("all", 2, 1, 0.2), ("one", 1, 1, 0.1)]
    df = spark.createDataFrame(rows, "target string, id int, label int, score double")
    got = {r.target: r for r in metrics.screening_metrics(df, ["target"], "score", "label", ["id"]).collect()}
    assert got["none"].ef_1 == 0.0 and got["none"].bedroc == 0.0
    assert got["none"].auc_roc is None and got["none"].auc_pr is None
    assert got["all"].auc_roc is None and got["all"].auc_pr == 1.0 and got["all"].bedroc == 1.0
    assert got["one"].ef_5 == 1.0


def test_reversed_scores_mirror_the_area(spark):
    df = spark.createDataFrame(screen(), "target string, id int, label int, score double")
    up = metrics.ranking_areas(df, ["target"], "score", "label")
    down = metrics.ranking_areas(df.selectExpr("target", "label", "-score AS score"), ["target"], "score", "label")
    both = {r.target: r.auc_roc for r in up.collect()}, {r.target: r.auc_roc for r in down.collect()}
    for target, area in both[0].items():
        assert both[1][target] == pytest.approx(1 - area)


def test_collapse_uses_first_label(spark):
    rows = [("t", "x_active_1", 0.1), ("t", "x_active_2", 0.9), ("t", "y_decoy_1", 0.5)]
    df = spark.createDataFrame(rows, "target string, id string, score double")
    got = evaluate_screening(df, collapse=True).first()
    assert (got.n_rows, got.n_hits, got.auc_roc) == (2, 1, 1.0)


def test_inversions():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 17, 64, 65, 200):
        order = rng.permutation(n) * 3 + 5
        want = sum(order[i] > order[j] for i in range(n) for j in range(i + 1, n))
        assert correlation.count_inversions(order) == want


def tau_b(x, y):
    n = len(x)
    s = tx = ty = 0
    for i in range(n):
        for j in range(i + 1, n):
            a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            s += a * b
            tx += a != 0
            ty += b != 0
    return s / math.sqrt(tx * ty) if tx * ty else None


@pytest.mark.parametrize("block_rows", [65_536, 8])
@pytest.mark.parametrize("limits", LIMITS, ids=["window", "sliced"])
def test_rank_correlations(spark, block_rows, limits):
    rng = random.Random(11)
    rows = [
        (rng.choice(["a", "b", "b", "b"]), i, float(rng.randint(0, 15)), float(rng.randint(0, 9)))
        for i in range(120)
    ]
    df = spark.createDataFrame(rows, "target string, id int, x double, y double")
    tau = correlation.kendall_tau(df, ["target"], "x", "y", ["id"], block_rows=block_rows, **limits)
    for row in tau.collect():
        mine = [r for r in rows if r[0] == row.target]
        assert row.kendall == pytest.approx(tau_b([r[2] for r in mine], [r[3] for r in mine]))
    self_tau = correlation.kendall_tau(
        df.withColumn("same", df.x), ["target"], "x", "same", ["id"], block_rows=block_rows
    )
    assert all(r.kendall == pytest.approx(1.0) for r in self_tau.collect())


def test_linear_correlations(spark):
    rows = [("t", 1.0, 2.0), ("t", 1.0, 4.0), ("t", 3.0, 4.0), ("t", 4.0, 9.0)]
    df = spark.createDataFrame(rows, "target string, x double, y double")
    got = correlation.linear_correlations(df, ["target"], "x", "y", max_group_rows=0).first()
    assert got.pearson == pytest.approx(np.corrcoef([1, 1, 3, 4], [2, 4, 4, 9])[0, 1])
    assert got.spearman == pytest.approx(np.corrcoef([1.5, 1.5, 3, 4], [1, 2.5, 2.5, 4])[0, 1])


@pytest.mark.parametrize("block", [1, 3, 8, 40])
def test_blocks_and_their_grid_count_every_inversion_once(spark, block):
    rng = np.random.default_rng(block)
    orders = {"a": rng.permutation(45), None: rng.permutation(38), "c": np.arange(30)[::-1], "d": np.array([0])}
    rows = [(g, x + 1, int(y) + 1) for g, order in orders.items() for x, y in enumerate(order)]
    df = spark.createDataFrame(rows, "g string, _px long, _py long")
    got = {r.g: r.inversions for r in correlation._inversions(df, ["g"], block, True).collect()}
    assert got == {g: correlation.count_inversions(order) for g, order in orders.items()}


def mid_ranks(values):
    return {v: sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values}


@pytest.mark.parametrize("limits", LIMITS, ids=["window", "sliced"])
def test_mid_ranks_over_slices(spark, limits):
    rng = random.Random(2)
    # One value holds half of all rows of one large group.
    rows = [("hot", 5.0 if rng.random() < 0.5 else float(rng.randint(0, 12))) for _ in range(3000)]
    rows += [(rng.choice(["a", None]), float(rng.randint(0, 3))) for _ in range(60)] + [("one", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    want = {g: mid_ranks([v for h, v in rows if h == g]) for g in {g for g, _ in rows}}
    got = correlation.with_mid_rank(df, ["g"], "v", "rank", **limits).collect()
    assert len(got) == len(rows) and all(r["rank"] == want[r.g][r.v] for r in got)
    whole = correlation.with_mid_rank(df.select("v"), [], "v", "rank", **limits).collect()
    all_of = mid_ranks([v for _, v in rows])
    assert len(whole) == len(rows) and all(r["rank"] == all_of[r.v] for r in whole)


def test_slices_of_a_frequent_value_are_even(spark):
    df = spark.range(40_000).selectExpr("0 AS g", "CASE WHEN id % 2 = 0 THEN 7.0 ELSE id * 1.0 END AS v")
    df = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(16, "g", "v", "_row")
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]


@pytest.mark.parametrize("limits", LIMITS, ids=["window", "sliced"])
def test_incomplete_pairs_are_left_out(spark, limits):
    nan = float("nan")
    whole = [("t", 1, 1.0, 2.0), ("t", 2, 2.0, 1.0), ("t", 3, 3.0, 4.0), ("t", 4, 4.0, 3.0)]
    odd = [("t", 5, None, 9.0), ("t", 6, 9.0, nan), ("t", 7, nan, None), ("u", 1, None, 1.0)]
    schema = "target string, id int, x double, y double"
    for rows in (whole, whole + odd):
        got = correlation.ranking_metrics(spark.createDataFrame(rows, schema), ["target"], "x", "y", ["id"], **limits).collect()
        assert [(r.target, r.n, round(r.pearson, 9), round(r.spearman, 9), round(r.kendall, 9)) for r in got] == [
            ("t", 4, 0.6, 0.6, round(1 / 3, 9))
        ]


@pytest.mark.parametrize("bins", [65_536, 3])
@pytest.mark.parametrize("limits", [2_000_000, 0])
def test_few_hits_have_the_ranks_of_a_sort(spark, bins, limits):
    rng = random.Random(6)
    odd = [float("nan"), None, float("inf"), float("-inf"), 1e300, -1e300]

    def score():
        return rng.choice(odd) if rng.random() < 0.1 else round(rng.gauss(0, 1), rng.choice([1, 6]))

    rows = [(rng.choice(["a", "b", "b", None]), i, int(rng.random() < 0.04), score()) for i in range(1500)]
    rows += [("flat", 2000 + i, int(i % 20 == 0), 0.5) for i in range(60)] + [("none", 3000, 0, 0.1), ("lost", 3001, 1, None)]
    df = spark.createDataFrame(rows, "target string, id int, label int, score double").repartition(3)
    few = metrics._ranked_few_hits(df, ["target"], "score", "label", ["id"], limits, bins)
    all_of = metrics._ranked_hits(df, ["target"], "score", "label", ["id"], limits, None)
    key = lambda r: (r[0] is None, r[0], r[1])
    assert sorted(map(tuple, few.collect()), key=key) == sorted(map(tuple, all_of.collect()), key=key)


def test_rows_far_from_hits_are_not_sorted(spark, monkeypatch):
    seen = []
    plain = metrics.ranked
    monkeypatch.setattr(metrics, "ranked", lambda rows, *args: (seen.append(rows.count()), plain(rows, *args))[1])
    df = spark.range(20_000).selectExpr("'t' AS target", "id", "CAST(id % 1000 = 7 AS INT) AS label", "id * 1.0 AS score")
    got = metrics.early_recognition(df, ["target"], "score", "label", ["id"]).first()
    assert (got.n_rows, got.n_hits) == (20_000, 20) and seen[0] < 100
