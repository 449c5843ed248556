"""Feature attributions of tree ensembles and their rankings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dockspan.functions.columns import column
from dockspan.operators.forest import Forest, PART_NODES, feature_matrix, forest_parts, goes_to

# Bits of a pattern that stands for a subtree, and for a single leaf; longer paths have no table.
SUBTREE_BITS, LEAF_BITS = 7, 10
# Rows worked on at a time, rows that every plan sees before the next one is read, numbers in a plan's tables.
BLOCK_ROWS, PLAN_ROWS, TABLE_VALUES = 4096, 1 << 16, 1 << 25
BLOCK_VALUES = 1_000_000


def leaf_paths(forest: Forest) -> list[tuple[float, list[tuple[int, list[tuple[int, int]], float]]]]:
    """Leaves with, per distinct feature on the path, its steps and cover share."""
    return [leaf for root in forest.roots for leaf in _paths_below(forest, int(root), {})]


def _paths_below(forest: Forest, top: int, path: dict) -> Iterator[tuple[float, list]]:
    """The leaves below ``top``, whose own path has {feature: (steps, share)}."""
    stack = [(top, path)]
    while stack:
        at, path = stack.pop()
        if forest.feature[at] < 0:
            yield forest.leaf[at], [(f, s, z) for f, (s, z) in path.items()]
            continue
        feature = int(forest.feature[at])
        for child in {int(forest.yes[at]), int(forest.no[at])}:
            steps, share = path.get(feature, ((), 1.0))
            share *= forest.cover[child] / forest.cover[at]
            stack.append((child, {**path, feature: ((*steps, (at, child)), share)}))


def path_values(follows: np.ndarray, share: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """Shapley values of paths: ``follows`` (leaves, size, cases), ``share`` (leaves, size), ``leaf`` (leaves).

    The value of a leaf for a set of known features is the product of "follows
    the path" over the known features and of cover shares over the others
    (Lundberg et al., 2018). The weight of a set of k of n other features,
    k! (n - k)! / (n + 1)!, is the integral of t^k (1 - t)^(n - k) over 0..1, so a
    sum over all sets is the integral of one product, which is a polynomial
    in t that a few Gauss-Legendre points integrate exactly.
    """
    size = follows.shape[1]
    points, weights = np.polynomial.legendre.leggauss((size + 1) // 2)
    total = np.zeros(follows.shape)
    others = np.empty(follows.shape)
    for t, w in zip((points + 1) / 2, weights / 2, strict=True):
        factor = share[:, :, None] * (1 - t) + follows * t
        run = np.full(follows[:, 0].shape, w)
        for i in range(size):
            others[:, i] = run
            run = run * factor[:, i]
        run = np.ones(run.shape)
        for i in range(size - 1, -1, -1):
            others[:, i] *= run
            run = run * factor[:, i]
        total += others
    return leaf[:, None, None] * (follows - share[:, :, None]) * total


@dataclass(frozen=True)
class Split:
    """Gives the patterns of both children: a bit is set if a row does not follow the path at its feature."""

    node: int
    bit: int
    source: int
    yes: int
    no: int


@dataclass(frozen=True)
class LookUp:
    """Adds a subtree's values: path bits, then one bit for every node of it whose test holds."""

    source: int
    nodes: np.ndarray
    path_bits: int
    features: np.ndarray
    bits: int
    row: int


@dataclass(frozen=True)
class DeepLeaves:
    """Leaves whose paths test equally many features, too many for a table.

    ``feature`` and ``share`` are (leaves, size); ``nodes`` and ``children`` list the
    tests in order of the (leaf, place) they belong to, which begin at ``first``.
    """

    leaf: np.ndarray
    feature: np.ndarray
    share: np.ndarray
    nodes: np.ndarray
    children: np.ndarray
    first: np.ndarray


@dataclass(frozen=True)
class PatternPlan:
    """What gives the attributions of some trees: steps, tables by number of bits, leaves without one."""

    forest: Forest
    steps: list[Split | LookUp]
    tables: dict[int, np.ndarray]
    deep: list[DeepLeaves]


class PlanBuilder:
    """Plans of a forest, each with tables of bounded size."""

    def __init__(self, forest: Forest, table_values: int = TABLE_VALUES):
        self.forest, self.table_values = forest, table_values
        self.inner = self._inner_nodes()
        self._clear()

    def _clear(self) -> None:
        self.steps: list[Split | LookUp] = []
        self.rows: dict[int, int] = {}
        # By number of bits and path size: (rows of the table, masks, wanted bits, shares, leaf).
        self.leaves: dict[tuple[int, int], list] = {}
        self.long: dict[int, list] = {}
        self.values = self.registers = 0

    def _inner_nodes(self) -> np.ndarray:
        """Inner nodes of every subtree; children come after their parents only along a walk."""
        forest, order = self.forest, []
        stack = [int(r) for r in forest.roots]
        while stack:
            at = stack.pop()
            order.append(at)
            if forest.feature[at] >= 0:
                stack += [int(forest.yes[at]), int(forest.no[at])]
        count = np.zeros(len(forest.leaf), np.int64)
        for at in reversed(order):
            if forest.feature[at] >= 0:
                count[at] = 1 + count[forest.yes[at]] + count[forest.no[at]]
        return count

    def plans(self) -> Iterator[PatternPlan]:
        for root in self.forest.roots:
            self._add_tree(int(root))
            if self.values >= self.table_values:
                yield self._plan()
        if self.steps or self.long:
            yield self._plan()

    def _add_tree(self, root: int) -> None:
        forest = self.forest
        # A path holds {feature: (steps, share)}; the place of a feature in it is its bit.
        stack = [(root, {}, self._register())]
        while stack:
            at, path, source = stack.pop()
            inner = int(self.inner[at])
            if len(path) + inner <= (SUBTREE_BITS if inner else LEAF_BITS):
                if path or inner:
                    self._add_table(at, path, source)
            elif len(path) >= LEAF_BITS:
                for leaf, steps in _paths_below(forest, at, path):
                    self.long.setdefault(len(steps), []).append((leaf, steps))
                self.steps.append(Split(-1, 0, source, -1, -1))
            else:
                feature, yes, no = int(forest.feature[at]), self._register(), self._register()
                bit = list(path).index(feature) if feature in path else len(path)
                self.steps.append(Split(at, bit, source, yes, no))
                steps, share = path.get(feature, ((), 1.0))
                for child, register in ((int(forest.no[at]), no), (int(forest.yes[at]), yes)):
                    part = share * forest.cover[child] / forest.cover[at]
                    stack.append((child, {**path, feature: ((*steps, (at, child)), part)}, register))

    def _register(self) -> int:
        self.registers += 1
        return self.registers

    def _add_table(self, top: int, path: dict, source: int) -> None:
        forest, path_bits = self.forest, len(path)
        nodes: dict[int, int] = {}
        features = {f: i for i, f in enumerate(path)}
        stack = [(top, {f: (1 << i, 0, z) for i, (f, (_, z)) in enumerate(path.items())})]
        found = []
        while stack:
            at, tests = stack.pop()
            if forest.feature[at] < 0:
                found.append((float(forest.leaf[at]), tests))
                continue
            feature = int(forest.feature[at])
            features.setdefault(feature, len(features))
            bit = 1 << (path_bits + nodes.setdefault(at, len(nodes)))
            mask, wanted, share = tests.get(feature, (0, 0, 1.0))
            for child, holds in ((int(forest.yes[at]), bit), (int(forest.no[at]), 0)):
                part = share * forest.cover[child] / forest.cover[at]
                stack.append((child, {**tests, feature: (mask | bit, wanted | holds, part)}))
        bits = path_bits + len(nodes)
        first = self.rows.get(bits, 0)
        self.rows[bits] = first + len(features)
        self.values += len(features) << bits
        for leaf, tests in found:
            self.leaves.setdefault((bits, len(tests)), []).append(
                ([first + features[f] for f in tests], [t[0] for t in tests.values()], [t[1] for t in tests.values()],
                 [t[2] for t in tests.values()], leaf)
            )
        self.steps.append(
            LookUp(source, np.array(list(nodes), np.int64), path_bits, np.array(list(features), np.int64), bits, first)
        )

    def _plan(self) -> PatternPlan:
        tables = {bits: np.zeros((rows, 1 << bits)) for bits, rows in self.rows.items()}
        for (bits, size), leaves in self.leaves.items():
            block = max(1, BLOCK_VALUES // (size << bits))
            for at in range(0, len(leaves), block):
                rows, mask, wanted, share, leaf = (np.array(x) for x in zip(*leaves[at : at + block], strict=True))
                differs = (np.arange(1 << bits) ^ wanted[:, :, None]) & mask[:, :, None]
                values = path_values((differs == 0).astype(float), share, leaf)
                np.add.at(tables[bits], rows.ravel(), values.reshape(-1, 1 << bits))
        plan = PatternPlan(self.forest, self.steps, tables, [_deep_leaves(n, x) for n, x in self.long.items()])
        self._clear()
        return plan


def _deep_leaves(size: int, found: list) -> DeepLeaves:
    tests = [
        (node, child, i * size + j)
        for i, (_, path) in enumerate(found)
        for j, (_, steps, _) in enumerate(path)
        for node, child in steps
    ]
    nodes, children, owner = np.array(tests).T
    return DeepLeaves(
        leaf=np.array([leaf for leaf, _ in found]),
        feature=np.array([[f for f, _, _ in path] for _, path in found]),
        share=np.array([[z for _, _, z in path] for _, path in found]),
        nodes=nodes,
        children=children,
        first=np.searchsorted(owner, np.arange(len(found) * size)),
    )


def add_values(plan: PatternPlan, matrix: np.ndarray, out: np.ndarray) -> None:
    """Add the attributions of the plan's trees for rows of ``matrix`` (rows, features) to ``out`` (features, rows)."""
    forest = plan.forest
    values = np.ascontiguousarray(matrix.T)
    missing = np.isnan(values)
    absent = missing.any(axis=1)

    def holds(node: int) -> np.ndarray:
        feature = forest.feature[node]
        below = values[feature] < forest.threshold[node]
        if absent[feature] and forest.missing[node] == forest.yes[node]:
            below |= missing[feature]
        return below

    patterns: dict[int, np.ndarray] = {}
    nothing = np.zeros(len(matrix), np.intp)
    for step in plan.steps:
        pattern = patterns.pop(step.source, nothing)
        if isinstance(step, Split):
            if step.node >= 0:
                below = holds(step.node)
                bit = np.intp(1 << step.bit)
                patterns[step.yes] = pattern | ~below * bit
                patterns[step.no] = pattern | below * bit
            continue
        for i, node in enumerate(step.nodes.tolist()):
            pattern = pattern | holds(node) * np.intp(1 << (step.path_bits + i))
        table = plan.tables[step.bits][step.row : step.row + len(step.features)]
        out[step.features] += np.take(table, pattern, axis=1, mode="clip")
    for group in plan.deep:
        _add_deep(forest, group, matrix, out)


def _add_deep(forest: Forest, group: DeepLeaves, matrix: np.ndarray, out: np.ndarray) -> None:
    leaves, size = group.share.shape
    order = np.argsort(group.feature.ravel(), kind="stable")
    features, first = np.unique(group.feature.ravel()[order], return_index=True)
    block = max(1, BLOCK_VALUES // (leaves * size))
    for at in range(0, len(matrix), block):
        rows = matrix[at : at + block]
        # A row fails a place of a path if any of the place's tests sends it elsewhere.
        taken = goes_to(forest, group.nodes[:, None], rows[:, forest.feature[group.nodes]].T) == group.children[:, None]
        follows = np.logical_and.reduceat(taken, group.first, axis=0).reshape(leaves, size, len(rows))
        values = path_values(follows.astype(float), group.share, group.leaf).reshape(leaves * size, len(rows))
        out[features, at : at + block] += np.add.reduceat(values[order], first, axis=0)


def shapley_values(plans: Sequence[PatternPlan], matrix: np.ndarray) -> np.ndarray:
    """Path-dependent Shapley values of every row and feature; plans of one forest add up."""
    out = np.zeros(matrix.shape)
    for at in range(0, len(matrix), BLOCK_ROWS):
        rows = matrix[at : at + BLOCK_ROWS]
        found = np.zeros(rows.shape[::-1])
        for plan in plans:
            add_values(plan, rows, found)
        out[at : at + BLOCK_ROWS] = found.T
    return out


def expected_margin(forest: Forest, base_margin: float = 0.0) -> float:
    """Mean margin over the training cover."""
    total = base_margin
    for leaf, path in leaf_paths(forest):
        share = 1.0
        for _, _, z in path:
            share *= z
        total += leaf * share
    return total


def row_attributions(
    rows: DataFrame,
    nodes: DataFrame | Forest,
    keys: Sequence[str],
    digits: int | None = None,
    part_nodes: int = PART_NODES,
    table_values: int = TABLE_VALUES,
) -> DataFrame:
    """``keys`` and ``values``, an array of ``(feature, value)`` per row.

    The values are attributions to the margin; with the expected margin they
    add up to the row's margin. A missing value must go to one of a node's two
    children. The model is read in parts; every part becomes plans whose tables
    hold about ``table_values`` numbers, and neither the driver nor a worker
    holds more than one part and one plan.
    """
    if isinstance(nodes, Forest):
        features, parts = sorted(nodes.features), iter([nodes])
    else:
        tested = nodes.filter(F.col("leaf").isNull()).select("feature").distinct()
        features, parts = sorted(r.feature for r in tested.collect()), forest_parts(nodes, part_nodes)
    context = rows.sparkSession.sparkContext
    # A broadcast of Python objects is a file on the driver, so a part is let go once its plans are sent.
    shared = [context.broadcast(plan) for forest in parts for plan in PlanBuilder(forest, table_values).plans()]
    used = F.struct(*[column(c) for c in rows.columns if c in set(features)] or [F.lit(None).cast("float").alias("_none")])
    value = _plan_values(shared, features)(used)
    if digits is not None:
        value = F.transform(value, lambda v: F.round(v, digits))
    names = F.array(*[F.lit(f) for f in features]).cast("array<string>")
    return rows.select(*keys, F.arrays_zip(names.alias("feature"), value.alias("value")).alias("values"))


def _plan_values(shared: list, features: list[str]):
    places = {f: i for i, f in enumerate(features)}

    @F.arrow_udf("array<double>")
    def shap(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for held in _gathered(batches, PLAN_ROWS):
            out = np.zeros((len(features), sum(len(b) for b in held)))
            for plan_file in shared:
                plan = plan_file.value
                own = np.array([places[f] for f in plan.forest.features])
                at = 0
                for batch in held:
                    for start in range(0, len(batch), BLOCK_ROWS):
                        rows = batch.slice(start, BLOCK_ROWS)
                        found = np.zeros((len(own), len(rows)))
                        add_values(plan, feature_matrix(rows, plan.forest), found)
                        out[own, at : at + len(rows)] += found
                        at += len(rows)
                if len(shared) > 1:
                    # Read again for the next rows, so that one plan is held at a time.
                    vars(plan_file).pop("_value", None)
            lists = out.T
            at = 0
            for batch in held:
                yield pa.FixedSizeListArray.from_arrays(
                    pa.array(lists[at : at + len(batch)].ravel()), max(len(features), 1)
                ).cast(pa.list_(pa.float64())) if features else pa.array([[]] * len(batch), pa.list_(pa.float64()))
                at += len(batch)

    return shap


def _gathered(batches: Iterator[pa.Array], rows: int) -> Iterator[list[pa.Array]]:
    """Batches in lists of about ``rows`` rows."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += len(batch)
        if count >= rows:
            yield held
            held, count = [], 0
    if held:
        yield held


def attribute(rows: DataFrame, nodes: DataFrame | Forest, keys: Sequence[str]) -> DataFrame:
    """Long table ``(keys, feature, value)`` of :func:`row_attributions`."""
    return row_attributions(rows, nodes, keys).select(*keys, F.inline("values"))


def rank_features(attributions: DataFrame, top: int | None = None) -> DataFrame:
    """Mean absolute attribution per feature, largest first."""
    ranking = (
        attributions.groupBy("feature")
        .agg(F.avg(F.abs("value")).alias("importance"))
        .orderBy(F.col("importance").desc(), "feature")
    )
    return ranking.limit(top) if top else ranking


def top_and_rest(
    attributions: DataFrame, keys: Sequence[str], max_display: int = 20
) -> DataFrame:
    """Per row the ``max_display - 1`` largest attributions and the sum of the rest.

    Works within the arrays of :func:`row_attributions`, without a shuffle.
    """
    ordered = F.array_sort(
        F.transform(
            "values",
            lambda v: F.struct(
                (-F.abs(v["value"])).alias("down"), v["feature"].alias("feature"), v["value"].alias("value")
            ),
        )
    )
    shown = max_display - 1
    placed = attributions.select(*keys, ordered.alias("_all"))
    rest = F.slice("_all", shown + 1, F.greatest(F.size("_all") - shown, F.lit(0)))
    total = F.aggregate(rest, F.lit(0.0), lambda s, v: s + v["value"])

    def entry(name: Column, value: Column, count: Column) -> Column:
        return F.struct(
            name.alias("feature"), value.alias("value"), count.cast("bigint").alias("n_features")
        )

    top = F.transform(
        F.slice("_all", 1, shown), lambda v: entry(v["feature"], v["value"], F.lit(1))
    )
    last = F.when(F.size(rest) > 0, F.array(entry(F.lit("rest"), total, F.size(rest))))
    return placed.select(*keys, F.inline(F.concat(top, F.coalesce(last, F.slice(top, 1, 0)))))
