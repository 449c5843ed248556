"""Scoring with tree ensembles given as node tables.

Node table: ``(tree, node, feature, threshold, yes, no, missing, leaf, cover)``.
Node 0 is a tree's root; ``leaf`` is NULL on inner nodes. A row goes to ``yes``
when its value is below the threshold, both taken as 32-bit floats, to
``missing`` when it has no value, and to ``no`` otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from dockspan.functions.columns import column

NODE_SCHEMA = T.StructType(
    [
        T.StructField("tree", T.IntegerType()),
        T.StructField("node", T.IntegerType()),
        T.StructField("feature", T.StringType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("yes", T.IntegerType()),
        T.StructField("no", T.IntegerType()),
        T.StructField("missing", T.IntegerType()),
        T.StructField("leaf", T.DoubleType()),
        T.StructField("cover", T.DoubleType()),
    ]
)
# Up to here one generated expression is about as fast as walking Arrow batches.
EXPRESSION_NODES = 64
# Nodes that are brought to the driver and broadcast at a time, about 300 MB of arrays.
PART_NODES = 5_000_000


@dataclass(frozen=True)
class Forest:
    """A node table as arrays; children are positions in the arrays."""

    features: list[str]
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    yes: np.ndarray
    no: np.ndarray
    missing: np.ndarray
    leaf: np.ndarray
    cover: np.ndarray


def forest_parts(nodes: DataFrame, part_nodes: int = PART_NODES) -> Iterator[Forest]:
    """One model's node table as forests of whole trees, one after the other.

    Margins and attributions of the parts add up to those of the model. A part
    has about ``part_nodes`` nodes, or one tree that is larger.
    """
    parts = -(-nodes.count() // part_nodes)
    if parts < 2:
        yield load_forest(nodes)
        return
    for part in range(parts):
        yield load_forest(nodes.filter(F.pmod(F.xxhash64("tree"), F.lit(parts)) == part))


def load_forest(nodes: DataFrame) -> Forest:
    """Bring a node table to the driver; ``forest_parts`` bounds how much at a time."""
    pdf = nodes.select(*NODE_SCHEMA.fieldNames()).toPandas()
    pdf = pdf.sort_values(["tree", "node"]).reset_index(drop=True)
    inner = pdf["leaf"].isna().to_numpy()
    known = pd.MultiIndex.from_frame(pdf[["tree", "node"]])

    def child(name: str) -> np.ndarray:
        asked = pdf.loc[inner, ["tree", name]].astype("int64")
        out = np.full(len(pdf), -1)
        out[inner] = known.get_indexer(pd.MultiIndex.from_frame(asked))
        if (out[inner] < 0).any():
            raise ValueError(f"a node's {name} child is not in the table")
        return out

    names = sorted(pdf.loc[inner, "feature"].unique())
    numbers = pd.Index(names).get_indexer(pdf["feature"])
    return Forest(
        features=names,
        roots=np.flatnonzero(pdf["node"].to_numpy() == 0),
        feature=np.where(inner, numbers, -1),
        threshold=pdf["threshold"].to_numpy(dtype=np.float32, na_value=np.nan),
        yes=child("yes"),
        no=child("no"),
        missing=child("missing"),
        leaf=pdf["leaf"].to_numpy(dtype=np.float64, na_value=np.nan),
        cover=pdf["cover"].to_numpy(dtype=np.float64, na_value=np.nan),
    )


def _tree_expression(forest: Forest, at: int, values: Mapping[str, Column]) -> Column:
    if forest.feature[at] < 0:
        return F.lit(float(forest.leaf[at]))
    name = forest.features[forest.feature[at]]
    if name not in values:
        return _tree_expression(forest, int(forest.missing[at]), values)
    value = values[name].cast("float")
    yes, no = (_tree_expression(forest, int(side[at]), values) for side in (forest.yes, forest.no))
    # A missing value is not below any limit: NULL is no match and NaN is the largest number.
    below = value < F.lit(float(forest.threshold[at])).cast("float")
    absent = value.isNull() | F.isnan(value)
    if forest.missing[at] == forest.no[at]:
        return F.when(below, yes).otherwise(no)
    if forest.missing[at] == forest.yes[at]:
        return F.when(absent | below, yes).otherwise(no)
    other = _tree_expression(forest, int(forest.missing[at]), values)
    return F.when(absent, other).when(below, yes).otherwise(no)


def score_expression(
    forest: Forest, values: Mapping[str, Column], start: Column | float = 0.0
) -> Column:
    """``start`` and the forest's margin as nested conditions on the feature values."""
    total = start if isinstance(start, Column) else F.lit(start)
    for root in forest.roots:
        total = total + _tree_expression(forest, int(root), values)
    return total


def probability(margin: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-margin))


def feature_matrix(rows: pd.DataFrame | pa.StructArray, forest: Forest) -> np.ndarray:
    """The forest's features of a batch as 32-bit floats; absent ones are NaN."""
    out = np.full((len(rows), len(forest.features)), np.nan, dtype=np.float32)
    arrow = isinstance(rows, pa.StructArray)
    held = {field.name for field in rows.type} if arrow else set(rows)
    for i, name in enumerate(forest.features):
        if name in held and arrow:
            out[:, i] = rows.field(name).cast(pa.float32(), safe=False).to_numpy(zero_copy_only=False)
        elif name in held:
            out[:, i] = rows[name].to_numpy(dtype=np.float32, na_value=np.nan)
    return out


def goes_to(forest: Forest, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The child that each value goes to from the node it is at."""
    below = np.where(values < forest.threshold[at], forest.yes[at], forest.no[at])
    return np.where(np.isnan(values), forest.missing[at], below)


def margins(forest: Forest, matrix: np.ndarray, base_margin: float) -> np.ndarray:
    rows = np.arange(len(matrix))
    total = np.full(len(matrix), base_margin)
    for root in forest.roots:
        at = np.full(len(matrix), root)
        while True:
            inner = forest.feature[at] >= 0
            if not inner.any():
                break
            moving = at[inner]
            at[inner] = goes_to(forest, moving, matrix[rows[inner], forest.feature[moving]])
        total += forest.leaf[at]
    return total


def score_forest(
    rows: DataFrame,
    nodes: DataFrame | Forest,
    name: str = "prediction",
    values: Mapping[str, Column] | None = None,
    base_margin: float = 0.0,
    logistic: bool = True,
    max_expression_nodes: int = EXPRESSION_NODES,
    part_nodes: int = PART_NODES,
) -> DataFrame:
    """Add the ensemble's prediction to each row.

    ``values`` gives a feature's value where it is not the column of that name.
    A small forest becomes one generated expression; a larger one is sent to
    the executors and walked for whole Arrow batches. A forest too large to be
    sent at once is scored in parts, whose margins are added.
    """
    total = F.lit(base_margin)
    for forest in [nodes] if isinstance(nodes, Forest) else forest_parts(nodes, part_nodes):
        own = values
        if own is None:
            own = {c: column(c) for c in rows.columns if c in set(forest.features)}
        if len(forest.leaf) <= max_expression_nodes:
            total = score_expression(forest, own, total)
        else:
            total = total + _batch_margin(rows, forest, own)
    return rows.withColumn(name, probability(total) if logistic else total)


@dataclass(frozen=True)
class MaskedTrees:
    """Trees of at most 64 * ``words`` leaves, scored by masks of the leaves that are still reachable.

    Leaves are numbered with the ``yes`` side first, so the leaf that a row
    reaches is the first one left. ``tables`` has, for every feature, its sorted
    limits, the trees that test it and, for every number of limits that a value
    is not below, which leaves of these trees are left; the last column is for
    a missing value. ``values`` are the leaves' values, (trees, leaves).
    """

    words: int
    tables: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]
    values: np.ndarray


# Numbers in the tables of one group of trees, leaves of a tree that masks pay for, rows masked at a time.
MASK_VALUES, MASK_LEAVES, MASK_ROWS = 1 << 23, 1024, 2048
# Fixed value: a de Bruijn sequence, by which a single set bit of 64 is told from the others.
SINGLE_BIT = np.uint64(0x03F79D71B4CB0A89)


def _bit_places() -> np.ndarray:
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    places = np.zeros(64, np.int64)
    places[(one * SINGLE_BIT) >> np.uint64(58)] = np.arange(64)
    return places


BIT_PLACES = _bit_places()


def _leaves_in_order(forest: Forest, root: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Leaves of a tree, the yes side first, and (node, first, end) of the leaves on every yes side."""
    leaves, sides = [], []
    stack: list[tuple[int, int | None]] = [(root, None)]
    while stack:
        at, started = stack.pop()
        if started is not None:
            sides.append((at, started, len(leaves)))
        elif forest.feature[at] < 0:
            leaves.append(at)
        else:
            stack += [(int(forest.no[at]), None), (at, len(leaves)), (int(forest.yes[at]), None)]
    return np.array(leaves), sides


def _bits_off(first: int, end: int, words: int) -> np.ndarray:
    """All bits but those from ``first`` to before ``end``."""
    whole = (1 << (64 * words)) - 1
    held = whole ^ ((1 << end) - (1 << first))
    return np.frombuffer(held.to_bytes(8 * words, "little"), "<u8").astype(np.uint64)


def masked_trees(forest: Forest, table_values: int = MASK_VALUES) -> tuple[list[MaskedTrees], list[int]]:
    """Groups of trees with tables of bounded size, and the roots of trees that are walked instead.

    Walked are trees of very many leaves and those where a missing value goes to neither child.
    """
    by_words: dict[int, list] = {}
    walked = []
    for root in forest.roots.tolist():
        leaves, sides = _leaves_in_order(forest, root)
        odd = any(forest.missing[n] not in (forest.yes[n], forest.no[n]) for n, _, _ in sides)
        if odd or len(leaves) > MASK_LEAVES:
            walked.append(root)
        else:
            by_words.setdefault(-(-len(leaves) // 64), []).append((leaves, sides))
    groups = []
    for words, trees in by_words.items():
        # The tables of n trees hold at most (n * nodes of a tree) limits for n trees.
        most = max(len(sides) for _, sides in trees) + 2
        count = max(1, int((table_values / (most * words)) ** 0.5))
        groups += [_mask_tables(forest, trees[at : at + count], words) for at in range(0, len(trees), count)]
    return groups, walked


def _mask_tables(forest: Forest, trees: list, words: int) -> MaskedTrees:
    tests: dict[int, list[tuple[float, int, int, np.ndarray]]] = {}
    values = np.zeros((len(trees), max(len(leaves) for leaves, _ in trees)))
    for number, (leaves, sides) in enumerate(trees):
        values[number, : len(leaves)] = forest.leaf[leaves]
        for node, first, end in sides:
            tests.setdefault(int(forest.feature[node]), []).append(
                (forest.threshold[node], number, node, _bits_off(first, end, words))
            )
    tables = []
    for feature, found in tests.items():
        limits = np.unique(np.array([t[0] for t in found], np.float32))
        numbers = np.array(sorted({t[1] for t in found}))
        table = np.full((len(numbers), words, len(limits) + 2), ~np.uint64(0))
        for limit, number, node, mask in found:
            row = table[np.searchsorted(numbers, number)]
            row[:, np.searchsorted(limits, limit) + 1] &= mask
            if forest.missing[node] == forest.no[node]:
                row[:, -1] &= mask
        np.bitwise_and.accumulate(table[:, :, :-1], axis=2, out=table[:, :, :-1])
        tables.append((feature, limits, numbers, table))
    return MaskedTrees(words, tables, values)


def masked_margins(group: MaskedTrees, matrix: np.ndarray) -> np.ndarray:
    """Sum of the values of the leaves that every row reaches in the trees of a group."""
    left = np.full((len(group.values), group.words, len(matrix)), ~np.uint64(0))
    for feature, limits, numbers, table in group.tables:
        values = matrix[:, feature]
        passed = np.searchsorted(limits, values, side="right")
        passed[np.isnan(values)] = len(limits) + 1
        if len(numbers) == len(left):
            left &= np.take(table, passed, axis=2, mode="clip")
        else:
            left[numbers] &= np.take(table, passed, axis=2, mode="clip")
    word = (left != 0).argmax(axis=1) if group.words > 1 else 0
    bits = np.take_along_axis(left, word[:, None], axis=1)[:, 0] if group.words > 1 else left[:, 0]
    lowest = bits & (~bits + np.uint64(1))
    leaf = 64 * word + BIT_PLACES[((lowest * SINGLE_BIT) >> np.uint64(58)).astype(np.intp)]
    return np.take_along_axis(group.values, leaf, axis=1).sum(axis=0)


def batch_margins(forest: Forest, groups: list[MaskedTrees], walked: list[int], matrix: np.ndarray) -> np.ndarray:
    total = np.zeros(len(matrix))
    for at in range(0, len(matrix), MASK_ROWS):
        rows = matrix[at : at + MASK_ROWS]
        for group in groups:
            total[at : at + MASK_ROWS] += masked_margins(group, rows)
        if walked:
            total[at : at + MASK_ROWS] += margins(replace(forest, roots=np.array(walked)), rows, 0.0)
    return total


def _batch_margin(rows: DataFrame, forest: Forest, values: Mapping[str, Column]) -> Column:
    shared = rows.sparkSession.sparkContext.broadcast((forest, *masked_trees(forest)))
    used = [values[f].cast("float").alias(f) for f in forest.features if f in values]

    @F.arrow_udf("double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trees, groups, walked = shared.value
        for batch in batches:
            yield pa.array(batch_margins(trees, groups, walked, feature_matrix(batch, trees)))

    # Without any feature of the forest a row still has a margin.
    return predict(F.struct(*(used or [F.lit(None).cast("float").alias("_none")])))
