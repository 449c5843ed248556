"""Screening metrics and rank correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from dockspan.operators import correlation, metrics
from dockspan.plans.evaluation import evaluate_ranking, evaluate_screening
from dockspan.queries.registry import query, rounded
from dockspan.queries.scoring import SCORED, scored
from dockspan.queries.views import PAIRS, POSE_KEY, SCREEN, pairs, screen, view

GROUP = ["target"]

EARLY = """
, placed AS (SELECT target, label,
    row_number() OVER (PARTITION BY target ORDER BY CASE WHEN NOT isnan(score) THEN score END DESC NULLS LAST, id) AS place,
    count(*) OVER (PARTITION BY target) AS n,
    sum(label) OVER (PARTITION BY target) AS hits FROM screen),
early AS (SELECT target, CAST(max(n) AS BIGINT) AS n_rows, CAST(max(hits) AS BIGINT) AS n_hits,
    sum(CASE WHEN label = 1 AND place <= ceil(n * 0.005::DOUBLE) THEN 1 ELSE 0 END)::DOUBLE
      / ceil(max(n) * 0.005::DOUBLE) * max(n) / max(hits) AS ef_0_5,
    sum(CASE WHEN label = 1 AND place <= ceil(n * 0.01::DOUBLE) THEN 1 ELSE 0 END)::DOUBLE
      / ceil(max(n) * 0.01::DOUBLE) * max(n) / max(hits) AS ef_1,
    sum(CASE WHEN label = 1 AND place <= ceil(n * 0.02::DOUBLE) THEN 1 ELSE 0 END)::DOUBLE
      / ceil(max(n) * 0.02::DOUBLE) * max(n) / max(hits) AS ef_2,
    sum(CASE WHEN label = 1 AND place <= ceil(n * 0.05::DOUBLE) THEN 1 ELSE 0 END)::DOUBLE
      / ceil(max(n) * 0.05::DOUBLE) * max(n) / max(hits) AS ef_5,
    sum(CASE WHEN label = 1 THEN exp(-80.5::DOUBLE * place / n) ELSE 0 END) AS w
  FROM placed GROUP BY target),
rie AS (SELECT *, CAST(n_hits AS DOUBLE) / n_rows AS ra, 80.5::DOUBLE AS a,
    w / (n_hits * (1 - exp(-80.5::DOUBLE)) / (n_rows * (exp(80.5::DOUBLE / n_rows) - 1))) AS rie
  FROM early),
bed AS (SELECT *, (1 - exp(-a * ra)) / (ra * (1 - exp(-a))) AS hi,
    (1 - exp(a * ra)) / (ra * (1 - exp(a))) AS lo FROM rie)
"""
AREAS = """
, levels AS (SELECT target, CASE WHEN NOT isnan(score) THEN score END AS score, count(*) AS n, sum(label) AS p
    FROM screen GROUP BY 1, 2),
curve AS (SELECT *, sum(n) OVER w AS cn, sum(p) OVER w AS cp FROM levels
    WINDOW w AS (PARTITION BY target ORDER BY score DESC NULLS LAST)),
areas AS (SELECT target, CAST(sum(p) AS BIGINT) AS n_hits,
    sum((n - p) * (cp - p / 2::DOUBLE)) / (sum(p) * sum(n - p)) AS auc_roc,
    sum(CAST(p AS DOUBLE) * cp / cn) / sum(p) AS auc_pr FROM curve GROUP BY target)
"""
SCREEN_SQL = f"WITH screen AS ({SCREEN})"
EF = "round(ef_0_5, 6) AS ef_0_5, round(ef_1, 6) AS ef_1, round(ef_2, 6) AS ef_2, round(ef_5, 6) AS ef_5"
BEDROC = "round((rie - lo) / (hi - lo), 6) AS bedroc"


@query(
    "enrichment", SCREEN_SQL + EARLY + f"SELECT target, n_rows, n_hits, {EF} FROM early"
)
def enrichment(spark, sf_dir):
    early = metrics.early_recognition(screen(spark, sf_dir), GROUP, "score", "label", ["id"])
    return rounded(early.drop("bedroc"))


@query("bedroc", SCREEN_SQL + EARLY + f"SELECT target, n_hits, {BEDROC} FROM bed")
def bedroc(spark, sf_dir):
    early = metrics.early_recognition(
        screen(spark, sf_dir), GROUP, "score", "label", ["id"], fractions={}
    )
    return rounded(early.select("target", "n_hits", "bedroc"))


# A screen where few rows are hits, as in practice.
FEW_SCREEN = SCREEN.replace("WHEN o_orderstatus = 'F' THEN", "WHEN o_orderkey % 31 = 3 THEN")


@query(
    "early_recognition_few_hits",
    f"WITH screen AS ({FEW_SCREEN})" + EARLY + f"SELECT target, n_rows, n_hits, {EF}, {BEDROC} FROM bed",
)
def early_recognition_few_hits(spark, sf_dir):
    rows = view(spark, sf_dir, FEW_SCREEN, "orders")
    return rounded(metrics.early_recognition(rows, GROUP, "score", "label", ["id"]))


@query(
    "auc_roc", SCREEN_SQL + AREAS + "SELECT target, n_hits, round(auc_roc, 6) AS auc_roc FROM areas"
)
def auc_roc(spark, sf_dir):
    areas = metrics.ranking_areas(screen(spark, sf_dir), GROUP, "score", "label")
    return rounded(areas.drop("auc_pr"))


@query(
    "auc_pr", SCREEN_SQL + AREAS + "SELECT target, n_hits, round(auc_pr, 6) AS auc_pr FROM areas"
)
def auc_pr(spark, sf_dir):
    areas = metrics.ranking_areas(screen(spark, sf_dir), GROUP, "score", "label")
    return rounded(areas.drop("auc_roc"))


COLLAPSED = (
    SCORED
    + f""", based AS (SELECT *, regexp_replace(lib_id, '_[^_]*$', '') AS id,
      CASE WHEN contains(lib_id, 'active') THEN 1 ELSE 0 END AS label FROM scored),
    screen AS (SELECT target, id, max(score) AS score,
      first(label ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, ps) AS label
      FROM based GROUP BY target, id)"""
)
VS = "SELECT target, n_rows, early.n_hits, {}, {}, round(auc_roc, 6) AS auc_roc, round(auc_pr, 6) AS auc_pr FROM bed AS early JOIN areas USING (target)".format(
    EF, BEDROC
)


@query("vs_evaluate", COLLAPSED + EARLY + AREAS + VS)
def vs_evaluate(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumnRenamed("lib_id", "id")
    return rounded(evaluate_screening(rows, keyword="active", collapse=True, first=POSE_KEY))


@query(
    "metric_summary",
    SCREEN_SQL
    + EARLY
    + AREAS
    + """, per AS (SELECT target, ef_1, (rie - lo) / (hi - lo) AS bedroc, auc_roc, auc_pr
        FROM bed JOIN areas USING (target)),
    long AS (UNPIVOT per ON ef_1, bedroc, auc_roc, auc_pr INTO NAME metric VALUE value)
    SELECT metric, round(avg(value), 6) AS mean_value, round(median(value), 6) AS median_value
    FROM long GROUP BY metric""",
)
def metric_summary(spark, sf_dir):
    per_target = metrics.screening_metrics(
        screen(spark, sf_dir), GROUP, "score", "label", ["id"]
    )
    return rounded(metrics.summarize(per_target, ["ef_1", "bedroc", "auc_roc", "auc_pr"]))


PAIRS_SQL = f"WITH pairs AS (SELECT * FROM ({PAIRS}) WHERE NOT isnan(pred))"
LINEAR = """
, places AS (SELECT *,
    rank() OVER (PARTITION BY target ORDER BY pred)
      + (count(*) OVER (PARTITION BY target, pred) - 1) / 2::DOUBLE AS rx,
    rank() OVER (PARTITION BY target ORDER BY measured)
      + (count(*) OVER (PARTITION BY target, measured) - 1) / 2::DOUBLE AS ry FROM pairs),
linear AS (SELECT target, count(*) AS n, corr(pred, -measured) AS pearson,
    corr(rx, -ry) AS spearman FROM places GROUP BY target)
"""
TAU = """
, signs AS (SELECT a.target, sign(a.pred - b.pred) AS sx, sign(b.measured - a.measured) AS sy
    FROM pairs a JOIN pairs b ON a.target = b.target AND a.id < b.id),
tau AS (SELECT target, sum(sx * sy) / (sqrt(sum(abs(sx))) * sqrt(sum(abs(sy)))) AS kendall
    FROM signs GROUP BY target)
"""


@query(
    "rank_correlation",
    PAIRS_SQL
    + LINEAR
    + TAU
    + """SELECT target, n, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman,
      round(kendall, 6) AS kendall FROM linear JOIN tau USING (target)""",
)
def rank_correlation(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    return rounded(
        evaluate_ranking(
            rows.select("target", "id", F.col("pred").alias("score")),
            rows.select("target", "id", F.col("measured").alias("exp_dg")),
        )
    )


@query(
    "kendall_tau",
    PAIRS_SQL
    + TAU
    + """SELECT target, count(*) AS n, round(any_value(kendall), 6) AS kendall
      FROM pairs JOIN tau USING (target) GROUP BY target""",
)
def kendall_tau(spark, sf_dir):
    rows = pairs(spark, sf_dir).withColumn("minus", -F.col("measured"))
    return rounded(correlation.kendall_tau(rows, GROUP, "pred", "minus", ["id"]))
