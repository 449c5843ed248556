"""Fitting and applying feature scalers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dockspan.functions.columns import column, present

# A row with more feature columns than this could not be planned either.
MAX_FEATURES = 100_000
KINDS = ("standard", "minmax", "maxabs")


def fit_scaler(rows: DataFrame, columns: Sequence[str], kind: str = "maxabs") -> DataFrame:
    """Parameter table ``(feature, ord, offset, scale)`` from one pass over ``rows``.

    Missing values are ignored and a zero scale becomes 1.
    """
    if kind not in KINDS:
        raise ValueError(f"choose the kind from {KINDS}")
    fits = []
    for position, name in enumerate(columns):
        value = present(column(name).cast("double"))
        if kind == "standard":
            offset, scale = F.avg(value), F.stddev_pop(value)
        elif kind == "minmax":
            offset, scale = F.min(value), F.max(value) - F.min(value)
        else:
            offset, scale = F.lit(0.0), F.max(F.abs(value))
        fits.append(
            F.struct(
                F.lit(name).alias("feature"),
                F.lit(position).alias("ord"),
                offset.alias("offset"),
                F.when(scale == 0.0, 1.0).otherwise(scale).alias("scale"),
            )
        )
    fitted = rows.agg(F.array(*fits).alias("fits"))
    return fitted.select(F.explode("fits").alias("fit")).select("fit.*")


def read_params(params: DataFrame, max_features: int = MAX_FEATURES) -> dict[str, tuple[float, float]]:
    """Scaler parameters by feature in order; one small row per model feature."""
    found = params.orderBy("ord").select("feature", "offset", "scale").limit(max_features + 1).collect()
    if len(found) > max_features:
        raise ValueError(f"more than {max_features} rows are no scaler of one feature row")
    return {r.feature: (r.offset, r.scale) for r in found}


def scaled(value: Column, offset: float, scale: float, fill: str) -> Column:
    value = present(value)
    if fill == "before":
        value = F.coalesce(value, F.lit(0.0))
    moved = (value - F.lit(offset)) / F.lit(scale)
    return F.coalesce(moved, F.lit(0.0)) if fill == "after" else moved


def apply_scaler(
    rows: DataFrame,
    params: Mapping[str, tuple[float, float]],
    keys: Sequence[str],
    fill: str = "before",
) -> DataFrame:
    """``keys`` and the scaled features, in the scaler's order.

    ``fill='before'`` sets missing values to 0 and then scales;
    ``fill='after'`` scales and then sets missing results to 0. A feature the
    rows do not have counts as 0 and is scaled.
    """
    if fill not in ("before", "after"):
        raise ValueError("fill must be 'before' or 'after'")
    have = set(rows.columns)
    columns = [
        scaled(
            column(name).cast("double") if name in have else F.lit(0.0), offset, scale, fill
        ).alias(name)
        for name, (offset, scale) in params.items()
    ]
    return rows.select(*keys, *columns)
