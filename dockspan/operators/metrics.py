"""Screening metrics per target: enrichment, BEDROC, ROC and PR area."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from dockspan.functions.columns import present
from dockspan.operators.consensus import best_first
from dockspan.operators.durable import durable
from dockspan.operators.joins import join_same
from dockspan.operators.ordering import WINDOW_ROWS, largest_group, ranked, running
from dockspan.operators.sizing import attach

# Early-recognition fractions and the BEDROC exponent.
FRACTIONS = {"ef_0_5": 0.005, "ef_1": 0.01, "ef_2": 0.02, "ef_5": 0.05}
ALPHA = 80.5
# Rows for each hit from which on a histogram pays, and its bins a group.
FEW_HITS, BINS = 10, 65_536


def collapse_poses(
    rows: DataFrame,
    group: Sequence[str],
    base: str,
    score: str,
    label: str,
    first: Sequence[str],
) -> DataFrame:
    """Best score per base name, with the label of its first row; missing scores only where there is no other."""
    return rows.groupBy(*group, base).agg(
        F.max(present(F.col(score).cast("double"))).alias(score),
        F.min_by(label, F.struct(*first)).alias(label),
    )


def _group_sizes(rows: DataFrame, group: Sequence[str], label: str) -> DataFrame:
    return rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col(label).cast("bigint")).alias("n_hits")
    )


def _ranked_hits(rows, group, score, label, ties, max_group_rows, largest):
    """Rank of every hit among all rows of its group, best score first."""
    order = [*best_first(score), *[F.col(t) for t in ties]]
    placed = ranked(
        rows.select(*group, score, label, *ties), group, order, "_rank", max_group_rows, largest
    )
    return placed.filter(F.col(label) == 1).select(*group, "_rank")


def _binned(rows: DataFrame, group: Sequence[str], score: str, bins: int) -> DataFrame:
    """Add ``_bin``, which falls as the score rises: finite scores by their range in the group, missing ones last."""
    value = present(F.col(score).cast("double"))
    endless = value.isin(float("inf"), float("-inf"))
    finite = F.when(~endless, value)
    ranges = rows.groupBy(*group).agg(F.min(finite).alias("_low"), F.max(finite).alias("_high"))
    share = (F.col("_high") - value) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
    inner = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1))
    place = F.when(value.isNull(), bins + 1).when(endless, F.when(value > 0, -1).otherwise(bins)).otherwise(inner)
    return attach(rows, ranges, group).withColumn("_bin", place.cast("int")).drop("_low", "_high")


def _ranked_few_hits(rows, group, score, label, ties, max_group_rows, bins=BINS):
    """The same ranks without a sort of all rows: a histogram counts the rows of better bins.

    Only rows that share a bin with a hit are put in order.
    """
    narrow = _binned(rows.select(*group, score, label, *ties), group, score, bins)
    counts = durable(
        narrow.groupBy(*group, "_bin").agg(F.count(F.lit(1)).alias("_n"), F.max(F.col(label)).alias("_hit"))
    )
    better = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    held = counts.withColumn("_ahead", F.coalesce(F.sum("_n").over(better), F.lit(0))).filter(F.col("_hit") == 1)
    near = attach(narrow, held.select(*group, "_bin", "_ahead"), [*group, "_bin"])
    order = [*best_first(score), *[F.col(t) for t in ties]]
    fullest = counts.filter(F.col("_hit") == 1).agg(F.coalesce(F.max("_n"), F.lit(0)).alias("n")).first()["n"]
    placed = ranked(near, [*group, "_bin"], order, "_place", max_group_rows, fullest)
    return placed.filter(F.col(label) == 1).select(*group, (F.col("_ahead") + F.col("_place")).alias("_rank"))


def early_recognition(
    rows: DataFrame,
    group: Sequence[str],
    score: str,
    label: str,
    ties: Sequence[str],
    fractions: dict[str, float] | None = None,
    alpha: float = ALPHA,
    max_group_rows: int = WINDOW_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Enrichment factors and BEDROC per group in one pass over the ranked hits.

    Where at most one row in ``FEW_HITS`` is a hit, a histogram of the scores
    leaves only the rows near hits to be sorted; the ranks are the same.
    Enrichment at f is the hit rate among the first ceil(N f) rows divided by
    the overall hit rate. Groups without hits get 0.
    """
    fractions = FRACTIONS if fractions is None else fractions
    sizes = durable(_group_sizes(rows, group, label))
    counts = sizes.agg(F.max("n_rows").alias("most"), F.sum("n_rows").alias("rows"), F.sum("n_hits").alias("hits")).first()
    if (counts["hits"] or 0) * FEW_HITS <= (counts["rows"] or 0):
        ranks = _ranked_few_hits(rows, group, score, label, ties, max_group_rows)
    else:
        most = counts["most"] if largest is None else largest
        ranks = _ranked_hits(rows, group, score, label, ties, max_group_rows, most)
    hits = attach(ranks, sizes, group)
    cut = {n: F.ceil(F.col("n_rows") * f) for n, f in fractions.items()}
    found = hits.groupBy(*group).agg(
        F.sum(F.exp(-alpha * F.col("_rank") / F.col("n_rows"))).alias("_weight"),
        *[F.count_if(F.col("_rank") <= k).alias(f"_{n}") for n, k in cut.items()],
    )
    per_group = join_same(sizes, found, group, "left")
    n, hit = F.col("n_rows").cast("double"), F.col("n_hits").cast("double")
    factors = [
        F.when(F.col("n_hits") == 0, 0.0)
        .otherwise(F.col(f"_{name}") * n / F.nullif(k * hit, F.lit(0.0)))
        .alias(name)
        for name, k in cut.items()
    ]
    a = F.lit(float(alpha))
    share = hit / n
    # Robust initial enhancement, scaled between its worst and best values
    # (Truchon and Bayly, 2007).
    spread = (1.0 - F.exp(-a)) / (n * (F.exp(a / n) - 1.0))
    rie = F.col("_weight") / F.nullif(hit * spread, F.lit(0.0))
    best = (1.0 - F.exp(-a * share)) / F.nullif(share * (1.0 - F.exp(-a)), F.lit(0.0))
    worst = (1.0 - F.exp(a * share)) / F.nullif(share * (1.0 - F.exp(a)), F.lit(0.0))
    bedroc = (
        F.when(F.col("n_hits") == 0, 0.0)
        .when(F.col("n_hits") == F.col("n_rows"), 1.0)
        .otherwise((rie - worst) / F.nullif(best - worst, F.lit(0.0)))
    )
    return per_group.select(*group, "n_rows", "n_hits", *factors, bedroc.alias("bedroc"))


def ranking_areas(
    rows: DataFrame,
    group: Sequence[str],
    score: str,
    label: str,
    max_group_rows: int = WINDOW_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """ROC area and average precision per group; NULL when undefined.

    Rows are first reduced to one per distinct score, so ties need no
    tie-break and many equal scores cost nothing after the first shuffle. Missing
    scores are one level below all others.
    """
    hit = F.col(label).cast("bigint")
    level = present(F.col(score).cast("double")).alias("_level")
    levels = rows.groupBy(*group, level).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(hit).alias("_hits")
    )
    curve = running(
        levels,
        group,
        [F.col("_level").isNull(), F.col("_level").desc()],
        {"_cum_n": F.col("_n"), "_cum_hits": F.col("_hits")},
        max_group_rows=max_group_rows,
        largest=largest,
    )
    misses = F.col("_n") - F.col("_hits")
    won = misses * (F.col("_cum_hits") - F.col("_hits") / 2.0)
    precision = F.col("_hits") * F.col("_cum_hits") / F.col("_cum_n")
    sums = curve.groupBy(*group).agg(
        F.sum("_hits").alias("n_hits"),
        F.sum(misses).alias("_misses"),
        F.sum(won).alias("_won"),
        F.sum(precision).alias("_precision"),
    )
    pairs = F.nullif(F.col("n_hits") * F.col("_misses"), F.lit(0))
    return sums.select(
        *group,
        "n_hits",
        (F.col("_won") / pairs).alias("auc_roc"),
        (F.col("_precision") / F.nullif(F.col("n_hits"), F.lit(0))).alias("auc_pr"),
    )


def screening_metrics(
    rows: DataFrame,
    group: Sequence[str],
    score: str,
    label: str,
    ties: Sequence[str],
    max_group_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """All screening metrics per group in one row."""
    largest = largest_group(rows, group)
    early = early_recognition(
        rows, group, score, label, ties, max_group_rows=max_group_rows, largest=largest
    )
    areas = ranking_areas(rows, group, score, label, max_group_rows, largest).drop("n_hits")
    return join_same(early, areas, group)


def summarize(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean and median over groups, one row per metric."""
    long = metrics.select(
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])
        ).alias("m")
    ).select("m.metric", "m.value")
    return long.groupBy("metric").agg(
        F.avg("value").alias("mean_value"), F.median("value").alias("median_value")
    )
