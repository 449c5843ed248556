"""Evaluation runs over all targets in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from dockspan.functions.ids import base_library_name, label_from_id
from dockspan.operators.correlation import join_experiment, ranking_metrics
from dockspan.operators.durable import durable
from dockspan.operators.metrics import collapse_poses, screening_metrics


def evaluate_screening(
    scores: DataFrame,
    keyword: str = "active",
    collapse: bool = False,
    first: Sequence[str] = ("id",),
) -> DataFrame:
    """Screening metrics per target from ``(target, id, score)`` rows.

    Labels come from the id. With ``collapse`` the poses of one compound count
    once, with their best score and the label of the first row in ``first``
    order. Targets without both classes keep NULL areas instead of failing.
    """
    rows = scores.withColumn("label", label_from_id(F.col("id"), keyword))
    if collapse:
        named = rows.withColumn("base", base_library_name(F.col("id")))
        rows = collapse_poses(named, ["target"], "base", "score", "label", first)
        rows = rows.withColumnRenamed("base", "id")
    # The metrics read the scores several times; scoring them once is cheaper.
    stored = durable(rows.select("target", "id", "score", "label"))
    return screening_metrics(stored, ["target"], "score", "label", ["id"])


def evaluate_ranking(predictions: DataFrame, experiment: DataFrame) -> DataFrame:
    """Correlation of scores with minus the measured energy, per target.

    ``predictions(target, id, score)`` and ``experiment(target, id, exp_dg)``
    are joined by id; compounds missing on either side are left out.
    """
    joined = join_experiment(experiment, predictions).select(
        "target", "id", "score", (-F.col("exp_dg")).alias("minus_dg")
    )
    return ranking_metrics(durable(joined), ["target"], "score", "minus_dg", ["id"])
