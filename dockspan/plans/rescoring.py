"""From feature rows of all targets to ranked compounds, as one job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from dockspan.functions.columns import column
from dockspan.operators import consensus
from dockspan.operators.forest import Forest, score_forest
from dockspan.operators.scaling import scaled


def two_model_scores(
    features: DataFrame,
    keys: Sequence[str],
    scalers: Mapping[str, Mapping[str, tuple[float, float]]],
    forests: Mapping[str, DataFrame | Forest],
    weights: tuple[float, float] = (consensus.PS_WEIGHT, consensus.PB_WEIGHT),
    fill: str = "before",
) -> DataFrame:
    """Fill, align, scale and score each row with both models and mix the scores.

    Both models read the same row, so their results need no join. ``scalers``
    and ``forests`` have the entries ``ps`` and ``pb``.
    """
    have = set(features.columns)
    scores = features
    for model in ("ps", "pb"):
        values = {
            name: scaled(
                column(name).cast("double") if name in have else F.lit(0.0), offset, scale, fill
            )
            for name, (offset, scale) in scalers[model].items()
        }
        scores = score_forest(scores, forests[model], model, values)
    return consensus.with_consensus(scores.select(*keys, "ps", "pb"), weights=weights)


def rescore(
    features: DataFrame,
    keys: Sequence[str],
    scalers: Mapping[str, Mapping[str, tuple[float, float]]],
    forests: Mapping[str, DataFrame | Forest],
    weights: tuple[float, float] = (consensus.PS_WEIGHT, consensus.PB_WEIGHT),
    target: str = "target",
) -> DataFrame:
    """Ranked consensus scores per target."""
    scores = two_model_scores(features, keys, scalers, forests, weights)
    ties = [k for k in keys if k != target]
    return consensus.rank_by_score(scores, ties=ties, group=[target])


def best_poses(
    ranked: DataFrame,
    compound_id: str = "compound_id",
    group: Sequence[str] = ("target",),
    first: Sequence[str] = ("rank",),
    rank_scope: str = "pose",
) -> DataFrame:
    """Best pose per compound of ranked rows.

    ``rank_scope='pose'`` keeps the rank among all poses; ``'compound'`` numbers
    the remaining rows anew.
    """
    best = consensus.best_pose(ranked, group, first=first, compound_id=compound_id)
    if rank_scope == "pose":
        return best
    if rank_scope != "compound":
        raise ValueError("rank_scope must be 'pose' or 'compound'")
    return consensus.rank_by_score(
        best.drop("rank"), ties=["base_compound"], group=list(group)
    )
