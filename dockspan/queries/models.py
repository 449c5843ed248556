"""Feature tables, scalers, forest scores and attributions."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from dockspan.functions.literals import literal_table
from dockspan.operators import attribution, consensus, features as feature_ops, scaling
from dockspan.operators.forest import Forest, load_forest, NODE_SCHEMA, score_forest
from dockspan.operators.durable import scratch_table, stored
from dockspan.plans.rescoring import rescore, two_model_scores
from dockspan.queries.registry import ORACLES, query, rounded
from dockspan.queries.spatial import pose_features
from dockspan.queries.views import FEATURE_KEY, FEATURES, features
from dockspan.sources.features import read_feature_csv, read_feature_lists, write_feature_csv

COLUMNS = ["f_quantity", "f_price", "f_discount", "f_tax"]
ALIGNED = ["f_tax", "f_missing", "f_quantity", "f_price", "f_discount"]
KEY_SQL = ", ".join(FEATURE_KEY)
FEATURES_SQL = f"WITH features AS ({FEATURES})"

# Two models of two trees: (tree, node, feature, threshold, yes, no, missing, leaf, cover).
MODELS = {
    "ps": [
        (0, 0, "f_quantity", 0.5, 1, 2, 1, None, 100.0),
        (0, 1, "f_price", 0.25, 3, 4, 4, None, 50.0),
        (0, 2, "f_discount", 0.55, 5, 6, 6, None, 50.0),
        (0, 3, None, None, None, None, None, -0.4, 20.0),
        (0, 4, None, None, None, None, None, 0.15, 30.0),
        (0, 5, None, None, None, None, None, 0.3, 35.0),
        (0, 6, None, None, None, None, None, -0.2, 15.0),
        (1, 0, "f_tax", 0.4, 1, 2, 2, None, 100.0),
        (1, 1, None, None, None, None, None, 0.25, 60.0),
        (1, 2, "f_tax", 0.75, 3, 4, 3, None, 40.0),
        (1, 3, None, None, None, None, None, -0.1, 25.0),
        (1, 4, None, None, None, None, None, 0.5, 15.0),
    ],
    "pb": [
        (0, 0, "f_discount", 0.35, 1, 2, 1, None, 80.0),
        (0, 1, "f_quantity", 0.3, 3, 4, 3, None, 40.0),
        (0, 2, "f_tax", 0.6, 5, 6, 5, None, 40.0),
        (0, 3, None, None, None, None, None, 0.35, 10.0),
        (0, 4, None, None, None, None, None, -0.25, 30.0),
        (0, 5, None, None, None, None, None, 0.1, 24.0),
        (0, 6, None, None, None, None, None, 0.45, 16.0),
        (1, 0, "f_price", 0.5, 1, 2, 2, None, 80.0),
        (1, 1, None, None, None, None, None, -0.3, 48.0),
        (1, 2, None, None, None, None, None, 0.2, 32.0),
    ],
}


NODE_FIELDS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in NODE_SCHEMA)


def nodes(spark, model: str):
    return literal_table(spark, MODELS[model], NODE_FIELDS)


def forest(spark, model: str) -> Forest:
    return load_forest(nodes(spark, model))


def _tree_sql(model: list[tuple], tree: int, node: int, value) -> str:
    """Nested CASE of one tree; ``value`` gives the SQL of a feature."""
    rows = {(r[0], r[1]): r for r in model}
    _, _, feature, threshold, yes, no, missing, leaf, _ = rows[(tree, node)]
    if leaf is not None:
        return f"CAST({leaf} AS DOUBLE)"
    x = f"CAST({value(feature)} AS FLOAT)"
    return (
        f"CASE WHEN {x} IS NULL THEN {_tree_sql(model, tree, missing, value)}"
        f" WHEN {x} < CAST({threshold} AS FLOAT) THEN {_tree_sql(model, tree, yes, value)}"
        f" ELSE {_tree_sql(model, tree, no, value)} END"
    )


def score_sql(model: list[tuple], value) -> str:
    trees = sorted({r[0] for r in model})
    margin = " + ".join(_tree_sql(model, t, 0, value) for t in trees)
    return f"1 / (1 + exp(-({margin})))"


@query(
    "read_features",
    FEATURES_SQL
    + f"""SELECT {KEY_SQL}, f_quantity, f_price, f_discount, f_tax FROM features""",
)
def read_features(spark, sf_dir):
    path = scratch_table(spark, "features")
    rows = features(spark, sf_dir)
    write_feature_csv(rows, path)
    return read_feature_csv(spark, path, rows.schema)


@query(
    "fill_align",
    FEATURES_SQL
    + f"""SELECT {KEY_SQL}, coalesce(f_tax, 0) AS f_tax, CAST(0 AS DOUBLE) AS f_missing,
      coalesce(f_quantity, 0) AS f_quantity, coalesce(f_price, 0) AS f_price,
      coalesce(f_discount, 0) AS f_discount FROM features""",
)
def fill_align(spark, sf_dir):
    rows = feature_ops.fill_missing(features(spark, sf_dir), COLUMNS)
    return feature_ops.align(rows, ALIGNED, FEATURE_KEY)


def read_lists(spark, lists: dict[str, list[str]]) -> dict[str, list[str]]:
    """Feature lists as a file of lists gives them."""
    path = scratch_table(spark, "lists")
    spark.createDataFrame([(json.dumps(lists),)], "value string").write.text(path)
    found = read_feature_lists(spark, path).orderBy("list_name", "ord").collect()
    return {name: [r.feature for r in found if r.list_name == name] for name in lists}


@query(
    "prune_features",
    FEATURES_SQL
    + """, long AS (UNPIVOT (SELECT l_orderkey, f_quantity, f_price, f_discount, f_tax FROM features)
        ON f_quantity, f_price, f_discount, f_tax INTO NAME feature VALUE value)
    SELECT feature, count(*) AS n_values,
      CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS total
    FROM long WHERE feature IN ('f_tax', 'f_price') GROUP BY feature""",
)
def prune_features(spark, sf_dir):
    listed = read_lists(spark, {"wanted": ["f_tax", "f_absent", "f_price"], "other": ["f_discount"]})
    rows, _ = feature_ops.prune(features(spark, sf_dir), listed["wanted"], FEATURE_KEY)
    kept = [c for c in rows.columns if c not in FEATURE_KEY]
    long = feature_ops.to_long(rows, FEATURE_KEY, kept)
    # Decimal sums do not depend on the order of the rows.
    total = F.sum(F.col("value").cast("decimal(18, 4)")).cast("double")
    return long.groupBy("feature").agg(F.count("value").alias("n_values"), total.alias("total"))


FITS = {
    "standard": ("avg({c})", "stddev_pop({c})"),
    "minmax": ("min({c})", "max({c}) - min({c})"),
    "maxabs": ("CAST(0 AS DOUBLE)", "max(abs({c}))"),
}


def fit_sql(kind: str) -> str:
    offset, scale = FITS[kind]
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {i} AS ord, {offset.format(c=c)} AS off,"
        f" coalesce(nullif({scale.format(c=c)}, 0), 1) AS scale FROM features"
        for i, c in enumerate(COLUMNS)
    )


def _register_scaler(kind: str) -> None:
    @query(
        f"scaler_fit_{kind}",
        FEATURES_SQL
        + f", fit AS ({fit_sql(kind)})"
        + """SELECT feature, CAST(ord AS INTEGER) AS ord, round(off, 4) AS "offset",
          round(scale, 4) AS scale FROM fit""",
    )
    def fit(spark, sf_dir):
        # Sums of doubles depend on their order; four digits do not.
        return rounded(scaling.fit_scaler(features(spark, sf_dir), COLUMNS, kind), digits=4)

    for fill in ("before", "after"):
        parts = []
        for c in COLUMNS:
            off, scl = (f"(SELECT {v} FROM fit WHERE feature = '{c}')" for v in ("off", "scale"))
            x = f"coalesce({c}, 0)" if fill == "before" else c
            moved = f"({x} - {off}) / {scl}"
            if fill == "after":
                moved = f"coalesce({moved}, 0)"
            parts.append(f"round({moved}, 4) AS {c}")

        @query(
            f"scaler_apply_{kind}_{fill}",
            FEATURES_SQL + f", fit AS ({fit_sql(kind)}) SELECT {KEY_SQL}, {', '.join(parts)} FROM features",
        )
        def apply(spark, sf_dir, fill=fill):
            rows = features(spark, sf_dir)
            params = scaling.read_params(scaling.fit_scaler(rows, COLUMNS, kind))
            return rounded(scaling.apply_scaler(rows, params, FEATURE_KEY, fill), COLUMNS, 4)


for _kind in FITS:
    _register_scaler(_kind)


def _unit_sql(feature: str) -> str:
    return {
        "f_quantity": "(f_quantity / 64)",
        "f_price": "(f_price / 131072)",
        "f_discount": "(f_discount / 0.125::DOUBLE)",
        "f_tax": "(f_tax / 0.0625::DOUBLE)",
    }[feature]


# Scaler parameters (offset, scale) as powers of two, exact in both engines.
UNIT = {
    "f_quantity": (0.0, 64.0),
    "f_price": (0.0, 131072.0),
    "f_discount": (0.0, 0.125),
    "f_tax": (0.0, 0.0625),
}


def unit_features(spark, sf_dir):
    rows = features(spark, sf_dir)
    return rows.select(
        *FEATURE_KEY, *[(F.col(c) / UNIT[c][1]).alias(c) for c in COLUMNS]
    )


@query(
    "forest_score",
    FEATURES_SQL
    + f"SELECT {KEY_SQL}, round({score_sql(MODELS['ps'], _unit_sql)}, 6) AS prediction FROM features",
)
def forest_score(spark, sf_dir):
    scored = score_forest(unit_features(spark, sf_dir), forest(spark, "ps"))
    return rounded(scored.select(*FEATURE_KEY, "prediction"), ["prediction"])


@query(
    "forest_score_batched",
    FEATURES_SQL
    + f"SELECT {KEY_SQL}, round({score_sql(MODELS['pb'], _unit_sql)}, 6) AS prediction FROM features",
)
def forest_score_batched(spark, sf_dir):
    scored = score_forest(
        unit_features(spark, sf_dir), forest(spark, "pb"), max_expression_nodes=0
    )
    return rounded(scored.select(*FEATURE_KEY, "prediction"), ["prediction"])


def _filled_sql(feature: str) -> str:
    return f"coalesce({_unit_sql(feature)}, 0)"


TWO_MODEL = (
    FEATURES_SQL
    + f""", scored AS (SELECT *, concat('t', l_suppkey % 10) AS target,
      {score_sql(MODELS['ps'], _filled_sql)} AS ps, {score_sql(MODELS['pb'], _filled_sql)} AS pb FROM features),
    mixed AS (SELECT *, round(ps * CAST(0.7 AS DOUBLE) + pb * CAST(0.3 AS DOUBLE), 12) AS score FROM scored)
    SELECT target, {KEY_SQL}, round(ps, 6) AS ps, round(pb, 6) AS pb, round(score, 6) AS score,
      row_number() OVER (PARTITION BY target ORDER BY score DESC, {KEY_SQL}) AS rank FROM mixed"""
)


@query("two_model_score", TWO_MODEL)
def two_model_score(spark, sf_dir):
    rows = features(spark, sf_dir).withColumn(
        "target", F.concat(F.lit("t"), (F.col("l_suppkey") % 10).cast("string"))
    )
    scalers = {"ps": UNIT, "pb": UNIT}
    forests = {m: forest(spark, m) for m in MODELS}
    ranked = rescore(rows, ["target", *FEATURE_KEY], scalers, forests)
    return rounded(ranked, ["ps", "pb", "score"])


def _leaves(model: str):
    """Leaves as (value, [(feature, sql condition, cover share), ...]) per step."""
    rows = {(r[0], r[1]): r for r in MODELS[model]}

    def walk(tree, node, steps):
        row = rows[(tree, node)]
        if row[7] is not None:
            yield row[7], steps
            return
        _, _, feature, threshold, yes, no, missing, _, cover = row
        x = f"CAST({_unit_sql(feature)} AS FLOAT)"
        limit = f"CAST({threshold} AS FLOAT)"
        for child, test in ((yes, f"{x} < {limit}"), (no, f"{x} >= {limit}")):
            known = f"coalesce({test}, {'TRUE' if missing == child else 'FALSE'})"
            share = rows[(tree, child)][8] / cover
            yield from walk(tree, child, [*steps, (feature, known, share)])

    for tree in sorted({r[0] for r in MODELS[model]}):
        yield from walk(tree, 0, [])


def shap_sql(model: str, wanted: str) -> str:
    """Closed form for leaves with at most two distinct features on their path."""
    terms = []
    for value, steps in _leaves(model):
        merged: dict[str, tuple[list[str], float]] = {}
        for feature, test, share in steps:
            tests, z = merged.get(feature, ([], 1.0))
            merged[feature] = ([*tests, test], z * share)
        if wanted not in merged:
            continue
        follow = {f: f"(CASE WHEN {' AND '.join(t)} THEN 1::DOUBLE ELSE 0::DOUBLE END)" for f, (t, _) in merged.items()}
        term = f"{value}::DOUBLE * ({follow[wanted]} - {merged[wanted][1]!r}::DOUBLE)"
        for other in merged:
            if other != wanted:
                term += f" * ({follow[other]} + {merged[other][1]!r}::DOUBLE) / 2"
        terms.append(term)
    return " + ".join(terms)


SHAP = (
    FEATURES_SQL
    + ", shap AS ("
    + " UNION ALL ".join(
        f"SELECT {KEY_SQL}, '{c}' AS feature, {shap_sql('ps', c)} AS value FROM features"
        for c in COLUMNS
    )
    + ")"
)


def attributions(spark, sf_dir):
    return attribution.attribute(unit_features(spark, sf_dir), forest(spark, "ps"), FEATURE_KEY)


@query("forest_attribution", SHAP + f"SELECT {KEY_SQL}, feature, round(value, 6) AS value FROM shap")
def forest_attribution(spark, sf_dir):
    return rounded(attributions(spark, sf_dir), ["value"])


@query(
    "feature_importance",
    SHAP
    + """SELECT feature, round(avg(abs(value)), 6) AS importance FROM shap
    GROUP BY feature ORDER BY avg(abs(value)) DESC, feature LIMIT 10""",
)
def feature_importance(spark, sf_dir):
    return rounded(attribution.rank_features(attributions(spark, sf_dir), top=10))


@query(
    "row_topk_rest",
    SHAP
    + f""", placed AS (SELECT *, row_number() OVER (PARTITION BY {KEY_SQL}
        ORDER BY round(abs(value), 9) DESC, feature) AS place FROM shap)
    SELECT {KEY_SQL}, CASE WHEN place < 3 THEN feature ELSE 'rest' END AS feature,
      round(sum(value), 6) AS value, count(*) AS n_features
    FROM placed GROUP BY {KEY_SQL}, CASE WHEN place < 3 THEN feature ELSE 'rest' END""",
)
def row_topk_rest(spark, sf_dir):
    values = attribution.row_attributions(
        unit_features(spark, sf_dir), forest(spark, "ps"), FEATURE_KEY, digits=9
    )
    return rounded(attribution.top_and_rest(values, FEATURE_KEY, max_display=3), ["value"])


# Models over interaction features, for the whole way from atoms to ranks.
FEATURE_MODELS = {
    "ps": [
        (0, 0, "4.0 (C, C)", 1.5, 1, 2, 1, None, 20.0),
        (0, 1, None, None, None, None, None, -0.5, 12.0),
        (0, 2, "BPF ALPHA SIDECHAIN", 4.0, 3, 4, 3, None, 8.0),
        (0, 3, None, None, None, None, None, 0.25, 5.0),
        (0, 4, None, None, None, None, None, 0.75, 3.0),
    ],
    "pb": [
        (0, 0, "C43000-C42200", 0.5, 1, 2, 1, None, 20.0),
        (0, 1, "LA HD", 0.5, 3, 4, 3, None, 11.0),
        (0, 2, None, None, None, None, None, 0.6, 9.0),
        (0, 3, None, None, None, None, None, -0.3, 4.0),
        (0, 4, None, None, None, None, None, 0.1, 7.0),
    ],
}
FEATURE_SCALERS = {
    "ps": {"4.0 (C, C)": (1.0, 2.0), "BPF ALPHA SIDECHAIN": (0.0, 4.0)},
    "pb": {"C43000-C42200": (0.0, 2.0), "LA HD": (0.0, 1.0)},
}


def _feature_score_sql(model: str) -> str:
    def value(feature: str) -> str:
        offset, scale = FEATURE_SCALERS[model][feature]
        return f'((f."{feature}" - {offset}::DOUBLE) / {scale}::DOUBLE)'

    return score_sql(FEATURE_MODELS[model], value)


@query(
    "screen_structures",
    f"""WITH f AS ({ORACLES['feature_pivot']}),
    scored AS (SELECT target, pose, {_feature_score_sql('ps')} AS ps,
      {_feature_score_sql('pb')} AS pb FROM f),
    mixed AS (SELECT *, ps * CAST(0.7 AS DOUBLE) + pb * CAST(0.3 AS DOUBLE) AS score FROM scored)
    SELECT target, pose, round(ps, 6) AS ps, round(pb, 6) AS pb, round(score, 6) AS score,
      row_number() OVER (PARTITION BY target ORDER BY round(score, 9) DESC, pose) AS rank FROM mixed""",
)
def screen_structures(spark, sf_dir):
    forests = {
        m: load_forest(literal_table(spark, rows, NODE_FIELDS)) for m, rows in FEATURE_MODELS.items()
    }
    wide = pose_features(spark, sf_dir)
    scores = two_model_scores(wide, ["target", "pose"], FEATURE_SCALERS, forests)
    # Ranking looks at the groups first, and then reads the scores again.
    near = stored(scores.withColumn("score", F.round("score", 9)), "scores")
    return rounded(consensus.rank_by_score(near, ties=["pose"]), ["ps", "pb", "score"])


# A generated model: complete trees whose splits and leaves follow from their numbers.
LARGE_TREES, LARGE_DEPTH = 200, 6
LARGE_FEATURES = {"f_quantity": 50.0, "f_price": 100000.0, "f_discount": 0.1, "f_tax": 0.08}


def large_forest(spark, trees: int = LARGE_TREES, depth: int = LARGE_DEPTH):
    """Node table of the generated model, made by Spark."""
    inner = 2**depth - 1
    names = F.array(*[F.lit(f) for f in LARGE_FEATURES])
    tree, node = F.col("tree"), F.col("node")
    split = node < inner
    return (
        spark.range(trees * (2 * inner + 1))
        .select(
            (F.col("id") / (2 * inner + 1)).cast("int").alias("tree"),
            (F.col("id") % (2 * inner + 1)).cast("int").alias("node"),
        )
        .select(
            tree,
            node,
            F.when(split, F.get(names, (tree + node) % 4)).alias("feature"),
            F.when(split, (tree * 31 + node * 17) % 97 / 97.0).alias("threshold"),
            F.when(split, node * 2 + 1).alias("yes"),
            F.when(split, node * 2 + 2).alias("no"),
            F.when(split, node * 2 + 1 + (tree + node) % 2).alias("missing"),
            F.when(~split, ((tree * 13 + node * 7) % 41 - 20) / 400.0).alias("leaf"),
            F.pow(F.lit(2.0), F.lit(depth) - F.floor(F.log2(node + 1))).alias("cover"),
        )
    )


_LARGE_STEP = """, s{b} AS (SELECT * EXCLUDE (node, x), CASE
    WHEN x IS NULL THEN node * 2 + 1 + (tree + node) % 2
    WHEN CAST(x AS FLOAT) < CAST(((tree * 31 + node * 17) % 97) / 97.0::DOUBLE AS FLOAT) THEN node * 2 + 1
    ELSE node * 2 + 2 END AS node
  FROM (SELECT *, v[(tree + node) % 4 + 1] AS x FROM s{a}))"""


def _large_sql(trees: int, depth: int, result: str) -> str:
    """The walk down all trees, level by level; ``result`` takes the margin."""
    values = ", ".join(f"{c} / {m}::DOUBLE" for c, m in LARGE_FEATURES.items())
    steps = "".join(_LARGE_STEP.format(a=i, b=i + 1) for i in range(depth))
    margin = "sum(((tree * 13 + node * 7) % 41 - 20) / 400.0::DOUBLE)"
    return (
        FEATURES_SQL
        + f", given AS (SELECT {KEY_SQL}, [{values}] AS v FROM features)"
        + f", s0 AS (SELECT given.*, t.tree, 0 AS node FROM given, range({trees}) AS t(tree)){steps}"
        + f" SELECT {KEY_SQL}, {result.format(margin)} FROM s{depth} GROUP BY {KEY_SQL}"
    )


@query(
    "forest_score_large",
    _large_sql(LARGE_TREES, LARGE_DEPTH, "round(1 / (1 + exp(-{})), 6) AS prediction"),
)
def forest_score_large(spark, sf_dir):
    values = {c: F.col(c) / F.lit(m) for c, m in LARGE_FEATURES.items()}
    scored = score_forest(features(spark, sf_dir), large_forest(spark), values=values, part_nodes=10_000)
    return rounded(scored.select(*FEATURE_KEY, "prediction"))


# Attributions of a model of many trees add up to the margin, which the check walks.
SPLIT_TREES, SPLIT_DEPTH = 100, 4


@query("forest_attribution_large", _large_sql(SPLIT_TREES, SPLIT_DEPTH, "round({}, 6) AS margin"))
def forest_attribution_large(spark, sf_dir):
    forest = load_forest(large_forest(spark, SPLIT_TREES, SPLIT_DEPTH))
    rows = features(spark, sf_dir).select(
        *FEATURE_KEY, *[(F.col(c) / F.lit(m)).alias(c) for c, m in LARGE_FEATURES.items()]
    )
    found = attribution.row_attributions(rows, forest, FEATURE_KEY)
    total = F.aggregate("values", F.lit(attribution.expected_margin(forest)), lambda s, v: s + v["value"])
    return rounded(found.select(*FEATURE_KEY, total.alias("margin")))
