"""Scalar rules on atom names and fixed-width structure lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from dockspan.functions.fixed_values import TWO_LETTER_ELEMENTS

# 0-based half-open columns of a structure line.
FIELDS = {
    "serial": (6, 12),
    "name": (11, 16),
    "resname": (16, 20),
    "chain": (21, 22),
    "resid": (22, 26),
    "x": (30, 38),
    "y": (38, 46),
    "z": (46, 54),
    "charge": (69, 76),
    "atom_type": (77, 79),
}
# Fixed value: the narrower residue-number columns that lose thousands.
NARROW_RESID = (23, 26)


def field(line: Column, name: str) -> Column:
    start, end = FIELDS[name]
    return F.trim(F.substring(line, start + 1, end - start))


def element_of_name(name: Column) -> Column:
    """Element symbol from an atom name.

    A known two-letter symbol at the start wins; otherwise it is the first
    character that is neither a digit nor ``@``.
    """
    bare = F.trim(name)
    pair = F.upper(F.trim(F.substring(bare, 1, 2)))
    single = F.upper(F.substring(F.regexp_replace(bare, "[0-9@]", ""), 1, 1))
    return F.when(pair.isin(TWO_LETTER_ELEMENTS), pair).otherwise(F.trim(single))


def residue_name(text: Column) -> Column:
    """The right-most three characters, or ``MOL`` when blank."""
    short = F.trim(F.right(text, F.lit(3)))
    return F.when(short == "", "MOL").otherwise(short)
