"""Consensus scores, ranks and the best pose of each compound."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dockspan.functions.columns import present
from dockspan.functions.ids import base_compound, selected_pose
from dockspan.operators.ordering import WINDOW_ROWS, ranked

# Default weights of the two models in the consensus.
PS_WEIGHT = 0.7
PB_WEIGHT = 0.3


def with_consensus(
    scores: DataFrame,
    ps: str = "ps",
    pb: str = "pb",
    weights: tuple[float, float] = (PS_WEIGHT, PB_WEIGHT),
    name: str = "score",
) -> DataFrame:
    """Add the weighted sum of two model scores; the weights must sum to 1."""
    if abs(sum(weights) - 1.0) > 1e-6:
        raise ValueError(f"weights must sum to 1, got {weights}")
    return scores.withColumn(name, F.col(ps) * weights[0] + F.col(pb) * weights[1])


def best_first(score: str) -> list[Column]:
    """Sorting keys that put high scores first and missing ones (NULL or NaN) last."""
    value = present(F.col(score).cast("double"))
    return [value.isNull(), -value]


def rank_by_score(
    scores: DataFrame,
    score: str = "score",
    ties: Sequence[str] = ("compound_id",),
    group: Sequence[str] = ("target",),
    name: str = "rank",
    max_group_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Rank from 1, best score first, missing scores last; ``ties`` makes the order total.

    With ``group=()`` the rank runs over the whole table.
    """
    order = [*best_first(score), *[F.col(t) for t in ties]]
    return ranked(scores, list(group), order, name, max_group_rows)


def best_pose(
    scores: DataFrame,
    group: Sequence[str] = ("target",),
    score: str = "score",
    first: Sequence[str] = ("compound_id",),
    compound: Column | None = None,
    compound_id: str = "compound_id",
) -> DataFrame:
    """The best-scoring row of each compound, with its pose label and pose count.

    Among equal scores the row that is first in ``first`` order wins, and a
    missing score wins only where a compound has no other. The
    winner is an aggregate, so a compound with very many poses is reduced
    before the shuffle.
    """
    base = base_compound(F.col(compound_id)) if compound is None else compound
    keys = [*group, "base_compound"]
    named = scores.withColumn("base_compound", base)
    rest = [c for c in scores.columns if c not in group]
    winners = named.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_poses"),
        F.min_by(
            F.struct(*rest),
            F.struct(*best_first(score), *[F.col(c) for c in first]),
        ).alias("_row"),
    )
    return winners.select(
        *group,
        *[F.col("_row")[c].alias(c) for c in rest],
        "base_compound",
        selected_pose(F.col("_row")[compound_id], F.col("base_compound")).alias("selected_pose"),
        "total_poses",
    )


def top_scores(
    scores: DataFrame,
    count: int = 5,
    score: str = "score",
    ties: Sequence[str] = ("compound_id",),
) -> DataFrame:
    """The ``count`` best rows of the table."""
    return scores.orderBy(*best_first(score), *ties).limit(count)


def result_summary(results: DataFrame, score: str = "score", poses: str = "total_poses") -> DataFrame:
    """One row: mean, sample deviation, range and multi-pose counts; missing scores are left out of the first three."""
    value = present(F.col(score).cast("double"))
    several = F.col(poses) > 1
    return results.agg(
        F.count(F.lit(1)).alias("n_compounds"),
        F.avg(value).alias("mean_score"),
        F.stddev_samp(value).alias("std_score"),
        F.min(value).alias("min_score"),
        F.max(value).alias("max_score"),
        F.count_if(several).alias("multi_pose_compounds"),
        F.avg(F.when(several, F.col(poses))).alias("mean_poses_multi"),
    )


def prediction_stats(scores: DataFrame, score: str, group: Sequence[str] = ()) -> DataFrame:
    """Range, mean and population deviation; scores within [0, 1] are probabilities. Missing scores are left out."""
    value = present(F.col(score).cast("double"))
    within = (F.min(value) >= 0.0) & (F.max(value) <= 1.0)
    return scores.groupBy(*group).agg(
        F.min(value).alias("min_score"),
        F.max(value).alias("max_score"),
        F.avg(value).alias("mean_score"),
        F.stddev_pop(value).alias("std_score"),
        F.when(within, "probability").otherwise("raw").alias("output_kind"),
    )
