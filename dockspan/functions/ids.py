"""Rules on compound and target identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def base_compound(compound_id: Column) -> Column:
    """Compound name without its pose: the text before the first ``_pose``.

    Ids without ``_pose`` lose one trailing ``_<digits>``.
    """
    return F.when(
        F.contains(compound_id, F.lit("_pose")), F.substring_index(compound_id, "_pose", 1)
    ).otherwise(F.regexp_replace(compound_id, r"_\d+$", ""))


def base_library_name(compound_id: Column) -> Column:
    """Name used in evaluation: the id without its last ``_`` part."""
    return F.regexp_replace(compound_id, "_[^_]*$", "")


def selected_pose(compound_id: Column, base: Column) -> Column:
    """What is left of the id without its base, or ``original``."""
    rest = F.ltrim(F.replace(compound_id, base, F.lit("")), F.lit("_"))
    return F.when(rest == "", "original").otherwise(rest)


def label_from_id(compound_id: Column, keyword: str = "active") -> Column:
    """1 for actives and 0 for decoys by a word in the id.

    With ``active`` an id that contains ``inactive`` counts as active too,
    since the one word contains the other; use ``inactive`` for such libraries.
    """
    if keyword == "active":
        return F.contains(compound_id, F.lit("active")).cast("int")
    if keyword == "inactive":
        return 1 - F.contains(compound_id, F.lit("inactive")).cast("int")
    raise ValueError(f"keyword must be 'active' or 'inactive', got {keyword!r}")


def canonical_prediction_id(compound_id: Column) -> Column:
    """Prediction id: the text before ``.pdbqt``, trimmed."""
    return F.trim(F.substring_index(compound_id, ".pdbqt", 1))


def canonical_experiment_id(ligand: Column) -> Column:
    """Experiment id: trimmed, ``/`` as ``_``, number-like text as an integer."""
    text = F.replace(F.trim(ligand), F.lit("/"), F.lit("_"))
    number_like = text.rlike(r"^(\d+\.?\d*|\.\d+)$")
    whole = F.regexp_replace(F.substring_index(text, ".", 1), r"^0+(?=\d)", "")
    return F.when(number_like & (whole == ""), "0").when(number_like, whole).otherwise(text)


def target_of_file(path: Column, suffix: str) -> Column:
    """Target id of a feature file: its name without ``suffix``."""
    return F.substring_index(F.substring_index(path, "/", -1), suffix, 1)
