"""SimHash near-duplicates found with BK-trees.

Two fingerprints at most ``radius`` bits apart agree in at least ``blocks - radius``
of their blocks, so every choice of that many blocks gives shards that keep all links.
A shard's fingerprints form BK-trees, whose children are keyed by their distance to
the parent; a search follows only the edges within the radius. Links leave a shard as
a spanning star, never as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from dockspan.llm.batches import slices
from dockspan.llm.components import connected
from dockspan.operators.durable import durable

SEED = 42
BITS = 64
# A tree holds at most about this many fingerprints; larger shards get several trees.
TREE = 4096
QUERIES_AT_ONCE = 256


def fingerprint(text: bytes, words: int) -> int:
    """Majority bits over the XXH64 of all word shingles of one text; no word gives zero."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    width = min(words, len(tokens))
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(tokens) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist()))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").cast(pa.binary()).fill_null(b"")
                prints = np.array([fingerprint(t.as_py(), words) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints)], names=["doc_id", "print"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, print long")


class BkTree:
    """A BK-tree over distinct fingerprints, built and searched level by level.

    ``nearest`` is the member met on the way down that is least far from each member, and
    ``nearest_gap`` how far it is; the first member has none.
    """

    SPAN = BITS
    AT_ONCE = QUERIES_AT_ONCE

    @staticmethod
    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances between fingerprints side by side, from 0 to ``SPAN``."""
        return np.bitwise_count(a ^ b).astype(np.int64)

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.children = np.full((len(prints), self.SPAN + 1), -1, np.int32)
        self.nearest = np.zeros(len(prints), np.int64)
        self.nearest_gap = np.full(len(prints), self.SPAN + 1, np.int64)
        rest = np.arange(1, len(prints))
        node = np.zeros(len(rest), np.int64)
        while len(rest):
            edge = self.apart(prints[rest], prints[node])
            nearer = edge < self.nearest_gap[rest]
            self.nearest[rest[nearer]], self.nearest_gap[rest[nearer]] = node[nearer], edge[nearer]
            free = self.children[node, edge] < 0
            # The first of those that share a free place takes it; the others go on below it.
            place, first = np.unique(node[free] * (self.SPAN + 1) + edge[free], return_index=True)
            self.children.ravel()[place] = rest[free][first]
            below = self.children[node, edge]
            left = below != rest
            rest, node = rest[left], below[left]

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) places of all pairs at most ``radius`` apart, in parts."""
        steps = np.arange(-radius, radius + 1)
        for at in range(0, len(queries), self.AT_ONCE):
            query = np.arange(at, min(at + self.AT_ONCE, len(queries)))
            node = np.zeros(len(query), np.int64)
            while len(query):
                distance = self.apart(queries[query], self.prints[node])
                near = distance <= radius
                if near.any():
                    yield query[near], node[near]
                edge = distance[:, None] + steps
                below = np.where((edge >= 0) & (edge <= self.SPAN), self.children[node[:, None], edge.clip(0, self.SPAN)], -1)
                row, column = np.nonzero(below >= 0)
                query, node = query[row], below[row, column].astype(np.int64)


def merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Forest of least members with the pairs (a, b) joined."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent = above


def links_of_shard(prints: np.ndarray, nodes: np.ndarray, in_tree: np.ndarray, both: bool, radius: int):
    """Spanning links of one group: the tree's members against themselves or against the others."""
    if len(prints) == 2:
        near = np.bitwise_count(prints[:1] ^ prints[1:]) <= radius
        return nodes[:1][near], nodes[1:][near]
    tree = np.flatnonzero(in_tree)
    asked = np.flatnonzero(~in_tree) if both else tree
    parent = np.arange(len(prints))
    if len(tree) and len(asked):
        for query, node in BkTree(prints[tree]).within(prints[asked], radius):
            parent = merge(parent, asked[query], tree[node])
    hung = np.flatnonzero(parent != np.arange(len(prints)))
    return nodes[hung], nodes[parent[hung]]


def runs_of_key(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of each run of rows with equal first ``keys`` columns, across batches."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        change = np.zeros(len(columns[0]) - 1, bool)
        for key in columns[:keys]:
            change |= key[1:] != key[:-1]
        edges = np.concatenate([[0], np.flatnonzero(change) + 1])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield [c[a:b] for c in columns]
        held = [c[edges[-1] :] for c in columns]
    if held is not None:
        yield held


def shard_keys(blocks: int, radius: int) -> Column:
    """Hashes of all choices of ``blocks - radius`` blocks of a fingerprint."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [
        F.shiftrightunsigned(F.col("print"), a).bitwiseAND(F.lit((1 << (b - a)) - 1))
        for a, b in zip(edges[:-1], edges[1:], strict=True)
    ]
    chosen = combinations(range(blocks), blocks - radius)
    return F.array(*[F.xxhash64(F.lit(n), *[parts[i] for i in own]) for n, own in enumerate(chosen)])


def near_links(classes: DataFrame, radius: int = 4, blocks: int = 6) -> DataFrame:
    """Links (a, b) that connect all classes (print, node) at most ``radius`` bits apart.

    A shard of more than TREE fingerprints is cut into parts by a hash; each part's tree is
    searched by itself and by every other part, in groups of at most two parts.
    """
    if blocks <= radius:
        raise ValueError("there must be more blocks than bits of the radius")
    keyed = classes.select(F.explode(shard_keys(blocks, radius)).alias("shard"), "print", "node")
    sizes = keyed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / TREE).cast("int")
    members = keyed.join(sizes, "shard").select(
        "shard", "print", "node", parts.alias("parts"), F.pmod(F.xxhash64("print"), parts).cast("int").alias("own")
    )
    grouped = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "print", "node"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, i, j, own, prints, nodes in runs_of_key(batches, 3):
            if len(prints) > 1:
                a, b = links_of_shard(prints.view(np.uint64), nodes, own == i[0], i[0] != j[0], radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = grouped.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, blocks: int = 6) -> DataFrame:
    """Fingerprint and component of every document: doc_id, print, component_id.

    Equal fingerprints are one class; classes link at ``radius`` or fewer differing bits
    and a component carries the least doc_id that links lead to. Null, empty and blank
    texts have fingerprint zero and link like any other. Rows without a doc_id give no
    name to a component and are in one only through an equal fingerprint. Repeated rows
    are returned as often as they come; other columns are left out.
    """
    prints = durable(fingerprints(docs, words))
    classes = durable(prints.groupBy("print").agg(F.min("doc_id").alias("node")).where("node IS NOT NULL"))
    roots = connected(near_links(classes, radius, blocks))
    named = classes.join(roots, "node", "left").select("print", F.coalesce("root", "node").alias("component_id"))
    return prints.join(named, "print", "left").select("doc_id", "print", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, blocks: int = 6) -> DataFrame:
    """One document of each component, that with the least doc_id, with all columns of ``docs``.

    Rows without a doc_id stay; rows that repeat the least doc_id stay together.
    """
    found = near_duplicates(docs, words, radius, blocks)
    dropped = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
