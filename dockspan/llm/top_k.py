"""Exact top-k by inner product with multi-resolution segment statistics.

A vector is cut into segments. With a segment's mean and deviation
``<x, y> <= sum over segments of L * (mx * my + sx * sy)``; the same statistics
bound the Euclidean distance from below. Bounds are taken coarse to fine: a
candidate whose bound stays under the query's k-th best score is left out, and
only survivors get their exact product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192
LEVELS = (1, 4, 16)
STEP = 1024


def statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Rows of scaled means and deviations whose products bound inner products from above."""
    edges = np.linspace(0, vectors.shape[1], segments + 1).astype(int)
    columns = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            part = vectors[:, a:b]
            scale = np.sqrt(b - a)
            columns += [part.mean(axis=1) * scale, part.std(axis=1) * scale]
    return np.stack(columns, axis=1) if columns else np.zeros((len(vectors), 1))


def exact(q: np.ndarray, c: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Products of the chosen pairs as whole numbers; floats only where they hold them exactly."""
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if largest < 2**53 and len(rows) * 8 > len(q) * len(c):
        return (q @ c.T)[rows, cols].astype(np.int64)
    parts = [np.empty(0, np.int64)]
    for i in range(0, len(rows), 1 << 15):
        a, b = q[rows[i : i + (1 << 15)]], c[cols[i : i + (1 << 15)]]
        if largest < 2**53:
            parts.append(np.einsum("ij,ij->i", a, b).astype(np.int64))
        else:
            products = [sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for u, v in zip(a, b, strict=True)]
            parts.append(np.array([max(-(2**63), min(2**63 - 1, x)) for x in products], np.int64))
    return np.concatenate(parts)


def best_of_block(
    q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, levels=LEVELS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every query the k best candidates of one block: query row, candidate id, score.

    Candidates come in steps; the k-th best score so far is the bar for the next step.
    """
    pairs = [(statistics(q, s), statistics(c, s)) for s in levels]
    # Rounding in the bounds is far below one part in 1e9 of the longest products.
    slack = 1e-9 * (np.linalg.norm(q, axis=1) * np.linalg.norm(c, axis=1).max(initial=0)) + 1e-6
    bar = np.full(len(q), -np.inf)
    kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    for at in range(0, len(c), STEP):
        own = slice(at, min(at + STEP, len(c)))
        alive = pairs[0][0] @ pairs[0][1][own].T + slack[:, None] >= bar[:, None]
        rows, cols = np.nonzero(alive)
        for by_query, by_candidate in pairs[1:]:
            if len(rows) * 4 > alive.size:  # nearly all are left: one product is cheaper than picking rows
                alive &= by_query @ by_candidate[own].T + slack[:, None] >= bar[:, None]
                rows, cols = np.nonzero(alive)
            else:
                bound = np.einsum("ij,ij->i", by_query[rows], by_candidate[own][cols])
                left = bound + slack[rows] >= bar[rows]
                rows, cols = rows[left], cols[left]
        different = q_ids[rows] != c_ids[own][cols]
        rows, cols = rows[different], cols[different]
        scores = exact(q, c[own], rows, cols)
        high = scores >= bar[rows]
        rows = np.concatenate([kept[0], rows[high]])
        ids = np.concatenate([kept[1], c_ids[own][cols[high]]])
        scores = np.concatenate([kept[2], scores[high]])
        order = np.lexsort((ids, ~scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        first = np.searchsorted(rows, np.arange(len(q)))
        rank = np.arange(len(rows)) - first[rows]
        take = rank < k
        kept = (rows[take], ids[take], scores[take])
        last = rank == k - 1
        bar[rows[last]] = scores[last]
    return kept


def packed(vectors: DataFrame, id_col: str, block: int, name: str) -> DataFrame:
    """Vectors as rows of whole blocks: ids and components as bytes, one row per block.

    A block is a run of at most ``block`` rows of one task, so no group is gathered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
            for width in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == width)
                for i in range(0, len(own), block):
                    rows = own[i : i + block]
                    body = values[(starts[rows][:, None] + np.arange(width)).ravel()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([int(width)], pa.int32()),
                            pa.array([ids[rows].astype("<i8").tobytes()], pa.binary()),
                            pa.array([body.astype("<f8").tobytes()], pa.binary()),
                        ],
                        names=["width", f"{name}_ids", f"{name}_values"],
                    )

    return vectors.select(id_col, "__v").mapInArrow(run, f"width int, {name}_ids binary, {name}_values binary")


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """Components as floor(scale * x); vectors null or with null or non-finite components go."""
    x = F.col(vector_col)
    usable = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.coalesce(usable, F.lit(False))).select(
        F.col(id_col).cast("long").alias(id_col),
        F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double")).alias("__v"),
    )


def top_k_search(
    vectors: DataFrame,
    query_ids,
    k: int = 20,
    scale: float = 64.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Each query's k highest whole-number inner products over all rows but those with its own id.

    ``query_ids`` is a condition on the id that names the queries. Ties go to the
    smaller id; with fewer than k partners all are returned; vectors of another
    length are no partners; sums beyond a long are held at its limits. A repeated id
    is a candidate as often as it occurs, and one query: that of its least vector.
    """
    own = whole_vectors(vectors, id_col, vector_col, scale)
    # Every query block meets every candidate block: the blocks of candidates are dealt to
    # parts, and each query block goes once to every part.
    parts = max(own.sparkSession.sparkContext.defaultParallelism, 1) * 2
    candidates = packed(own, id_col, CANDIDATE_BLOCK, "c").withColumn("part", F.pmod(F.xxhash64("c_ids"), F.lit(parts)))
    asked = own.where(query_ids).groupBy(id_col).agg(F.min("__v").alias("__v"))
    queries = packed(asked, id_col, QUERY_BLOCK, "q").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    )
    blocks = queries.join(candidates, ["width", "part"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                q_ids, c_ids = np.frombuffer(row.q_ids, "<i8"), np.frombuffer(row.c_ids, "<i8")
                q = np.frombuffer(row.q_values, "<f8").reshape(len(q_ids), -1)
                c = np.frombuffer(row.c_values, "<f8").reshape(len(c_ids), -1)
                rows, ids, scores = best_of_block(q_ids, q, c_ids, c, k)
                yield pd.DataFrame({"query_id": q_ids[rows], "vec_id": ids, "score": scores})

    found = blocks.mapInPandas(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    )
