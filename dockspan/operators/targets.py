"""Choosing targets and compounds, and seeing which are done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dockspan.functions.fixed_values import LOWER_CASE_LISTS, TARGET_LISTS
from dockspan.functions.ids import target_of_file
from dockspan.operators.joins import join_same
from dockspan.operators.sizing import small


def target_list(name: str) -> list[str]:
    """Target names of one of the named lists, spelled as in feature files."""
    if name not in TARGET_LISTS:
        raise ValueError(f"choose the list from {sorted(TARGET_LISTS)}")
    lower = name in LOWER_CASE_LISTS
    return [t.lower() if lower else t for t in TARGET_LISTS[name]]


def keep_listed_targets(rows: DataFrame, name: str, target: str = "target") -> DataFrame:
    """Rows whose target is in a named list; a literal list reaches the scan."""
    return rows.filter(F.col(target).isin(target_list(name)))


# Fixed value: mark in the names of feature files whose features are scaled.
SCALED_MARK = "_normalized"


def keep_listed_files(files: DataFrame, name: str, path: str = "path") -> DataFrame:
    """Files of scaled features whose target, the name before the mark, is in a named list."""
    file = F.substring_index(path, "/", -1)
    listed = target_of_file(F.col(path), SCALED_MARK).isin(target_list(name))
    return files.filter(F.contains(file, F.lit(SCALED_MARK)) & listed)


def filter_compound(rows: DataFrame, compound: str | Column, id_column: str = "compound_id") -> DataFrame:
    """Rows of one compound; none if it is unknown. ``require_compound`` tells so."""
    return rows.filter(F.col(id_column) == compound)


def require_compound(
    found: DataFrame, compound: str, features: int | None = None, keys: int = 1
) -> DataFrame:
    """``found`` itself; an error if it is empty or has another number of feature columns.

    ``features`` is the number a model expects beside ``keys`` key columns.
    """
    if features is not None and len(found.columns) - keys != features:
        raise ValueError(f"{len(found.columns) - keys} features for a model of {features}")
    if found.isEmpty():
        raise ValueError(f"compound {compound!r} not found")
    return found


def not_done(found: DataFrame, done: DataFrame, key: str = "target") -> DataFrame:
    """Found items without a result yet; a NULL item is done where a NULL one is."""
    return join_same(found, done.select(key), [key], "left_anti")


def coverage(found: DataFrame, processed: DataFrame, key: str = "target") -> DataFrame:
    """Each found target with the number of its processed rows."""
    counts = processed.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return join_same(found.select(key).distinct(), counts, [key], "left").select(
        key,
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_rows"),
        F.col("n").isNotNull().alias("processed"),
    )


def override_ids(
    predictions: DataFrame, overrides: DataFrame, keys: tuple[str, str] = ("target", "id")
) -> DataFrame:
    """Replace ids by an override table ``(target, id, new_id)``.

    ``overrides`` is a hand-kept list of corrections; ids without one stay.
    """
    target, ident = keys
    return predictions.join(small(overrides), list(keys), "left").select(
        *[
            F.coalesce("new_id", ident).alias(ident) if c == ident else F.col(c)
            for c in predictions.columns
        ]
    )
