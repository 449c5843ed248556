"""Ranked lexical search by presence masks.

Documents become postings of the terms that items ask for. For blocks of documents
every term has a bitmap; the bitmaps of an item's terms, turned by 90 degrees, are
the documents' presence masks, and equal masks form a group. A mask's score is at
most the sum of its terms' weights times their largest gains in the block, so masks
are evaluated from the largest such bound down, until no bound reaches the score of
the k-th best document so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, Window, functions as F

from dockspan.llm.batches import binaries, slices, texts_of
from dockspan.llm.tables import stored

# Bytes of text cut into terms at a time, documents of a block, and terms of the items worked on in one pass.
SLICE, BLOCK_DOCS, PASS_TERMS = 2 << 20, 1 << 14, 200_000
# A score adds weight * (ONE * tf div (1000 * tf + 12 * m)), m from 75 up by the length of the document.
ONE, LEAST_M, SPAN_M = 1_000_000_000, 75, 25


def _term_bytes() -> np.ndarray:
    """Which bytes belong to terms: digits, letters and all bytes of characters beyond ASCII."""
    kinds = np.zeros(256, bool)
    for first, last in (("0", "9"), ("A", "Z"), ("a", "z")):
        kinds[ord(first) : ord(last) + 1] = True
    kinds[128:] = True
    return kinds


TERM_BYTES = _term_bytes()


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Terms of all texts one after the other, A-Z lower-cased, and where each text's terms start."""
    texts = pc.ascii_lower(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = TERM_BYTES[data]
    first, final = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    final[:-1] &= ~inside[1:]
    # A term ends with its text even if the next text starts with one.
    heads, tails = offsets[offsets < len(data)], offsets[offsets > 0] - 1
    first[heads] = inside[heads]
    final[tails] = inside[tails]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(final) + 1 - starts
    terms = binaries(data[inside], np.concatenate([[0], np.cumsum(lengths)]))
    return terms, np.searchsorted(starts, offsets)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms) of every item with a term; repeats stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                terms, edges = terms_of(texts_of(part.column("text")))
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), terms)
                yield pa.RecordBatch.from_arrays([part.column("item_id"), lists], names=["item_id", "terms"])

    return items.select("item_id", "text").mapInArrow(run, "item_id long, terms array<binary>").where(F.size("terms") > 0)


def term_counts(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, counts) of every document: its terms, and places and counts of those in ``vocabulary``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.binary())
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                terms, edges = terms_of(texts_of(part.column("text")))
                counts = np.diff(edges)
                places = pc.fill_null(pc.index_in(terms, value_set=known), -1).to_numpy()
                found = places >= 0
                pairs = np.repeat(np.arange(len(counts)), counts)[found] * len(known) + places[found]
                pairs, times = np.unique(pairs, return_counts=True)
                ends = pa.array(np.searchsorted(pairs, np.arange(len(counts) + 1) * len(known)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(counts, pa.int64()),
                        pa.ListArray.from_arrays(ends, pa.array(pairs % len(known), pa.int32())),
                        pa.ListArray.from_arrays(ends, pa.array(times, pa.int32())),
                    ],
                    names=["doc_id", "n", "terms", "counts"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


@dataclass(frozen=True)
class Question:
    """An item as places of its different terms and their weights times their repeats."""

    item_id: int | None
    terms: np.ndarray
    weights: np.ndarray


def questions(rows: list[Row], places: dict[bytes, int], weights: np.ndarray) -> list[Question]:
    found = []
    for row in rows:
        terms, repeats = np.unique([places[bytes(t)] for t in row["terms"]], return_counts=True)
        found.append(Question(row["item_id"], terms, weights[terms] * repeats))
    return found


class Block:
    """Postings of some documents by term, with the gains of ``tf`` and bitmaps of the terms."""

    def __init__(self, lengths: np.ndarray, edges: np.ndarray, terms: np.ndarray, tf: np.ndarray, docs: int, total: int):
        owner = np.repeat(np.arange(len(lengths)), np.diff(edges))
        m = LEAST_M + SPAN_M * lengths * docs // max(total, 1)
        gain = ONE * tf // (1000 * tf + 12 * m[owner])
        order = np.argsort(terms, kind="stable")
        self.size, self.docs, self.gains = len(lengths), owner[order], gain[order]
        self.terms, self.starts = np.unique(terms[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))
        self.most = np.maximum.reduceat(self.gains, self.starts) if len(order) else self.gains
        self.bitmaps: dict[int, np.ndarray] = {}

    def bitmap(self, place: int) -> np.ndarray:
        """One bit for every document, set for those that hold the term at ``place`` of the block's terms."""
        found = self.bitmaps.get(place)
        if found is None:
            bits = np.zeros(self.size, bool)
            bits[self.docs[self.starts[place] : self.ends[place]]] = True
            found = self.bitmaps[place] = np.packbits(bits)
        return found

    def masks(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different masks as rows of bits, documents in order of their masks, and where each mask's start.

        The empty mask is left out.
        """
        some = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce([self.bitmap(p) for p in places]), count=self.size))
        bits = np.unpackbits(np.stack([self.bitmap(p) for p in places]), axis=1, count=self.size)[:, some]
        turned = np.packbits(bits, axis=0)
        words = np.zeros((-(-len(turned) // 8) * 8, len(some)), np.uint8)
        words[: len(turned)] = turned
        keys = np.ascontiguousarray(words.T).view(np.uint64)
        order = np.lexsort(keys.T)
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        return bits[:, order[starts]].T, some[order], starts

    def scores(self, docs: np.ndarray, places: np.ndarray, weights: np.ndarray) -> np.ndarray:
        total = np.zeros(len(docs), np.int64)
        for place, weight in zip(places.tolist(), weights.tolist(), strict=True):
            low, high = self.starts[place], self.ends[place]
            at = low + np.searchsorted(self.docs[low:high], docs)
            held = at < high
            held[held] = self.docs[at[held]] == docs[held]
            total[held] += weight * self.gains[at[held]]
        return total


class Best:
    """The best documents of every question so far; ids beyond ``no_id`` stand for nulls."""

    def __init__(self, asked: list[Question], k: int):
        self.asked, self.k = asked, k
        self.scores = [np.empty(0, np.int64) for _ in asked]
        self.ids = [np.empty(0, np.float64) for _ in asked]
        self.evaluated = self.matched = 0

    def add(self, block: Block, ids: np.ndarray, absent: np.ndarray) -> None:
        if not len(block.terms):
            return
        for number, question in enumerate(self.asked):
            places = np.searchsorted(block.terms, question.terms)
            held = places < len(block.terms)
            held[held] = block.terms[places[held]] == question.terms[held]
            if held.any():
                self._add(number, block, ids, absent, places[held], question.weights[held])

    def _add(self, number, block, ids, absent, places, weights) -> None:
        bits, docs, starts = block.masks(places)
        bounds = bits.astype(np.int64) @ (weights * block.most[places])
        ends = np.append(starts[1:], len(docs))
        order = np.argsort(-bounds, kind="stable")
        self.matched += len(docs)
        scores, best = self.scores[number], self.ids[number]
        done, step = 0, 4 * self.k
        while done < len(order):
            # A bound that equals the k-th score may still hide an equal score of a smaller id.
            bar = max(int(scores[-1]) if len(scores) == self.k else 1, 1)
            sizes = np.cumsum((ends - starts)[order[done:]])
            taken = order[done : done + 1 + int(np.searchsorted(sizes, step))]
            taken = taken[bounds[taken] >= bar]
            if not len(taken):
                break
            done += len(taken)
            step *= 2
            chosen = np.concatenate([docs[starts[t] : ends[t]] for t in taken.tolist()])
            self.evaluated += len(chosen)
            found = block.scores(chosen, places, weights)
            chosen, found = chosen[found >= bar], found[found >= bar]
            scores = np.concatenate([scores, found])
            best = np.concatenate([best, np.where(absent[chosen], None, ids[chosen])])
            last = np.array([x is None for x in best], bool)
            number_of = np.where(last, 0, best).astype(np.int64)
            top = np.lexsort((number_of, last, -scores))[: self.k]
            scores, best = scores[top], best[top]
        self.scores[number], self.ids[number] = scores, best


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    held, count = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            if count + part.num_rows > size:
                yield pa.Table.from_batches(held)
                held, count = [], 0
            held.append(part)
            count += part.num_rows
    if held:
        yield pa.Table.from_batches(held)


def best_by_task(postings: DataFrame, asked: list[Question], k: int, docs: int, total: int, block_docs: int) -> DataFrame:
    """(item, item_id, doc_id, score): every task's best documents of every question."""
    shared = postings.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(shared.value, k)
        for table in blocks(batches, block_docs):
            rows = table.combine_chunks().to_batches()
            for part in rows:
                terms = part.column("terms")
                edges = terms.offsets.to_numpy().astype(np.int64)
                flat = terms.flatten().to_numpy().astype(np.int64)
                tf = part.column("counts").flatten().to_numpy().astype(np.int64)
                ids = part.column("doc_id")
                block = Block(part.column("n").to_numpy(), edges - edges[0], flat, tf, docs, total)
                best.add(block, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        for number, question in enumerate(best.asked):
            found = len(best.scores[number])
            if found:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number] * found, pa.int32()),
                        pa.array([question.item_id] * found, pa.int64()),
                        pa.array(best.ids[number].tolist(), pa.int64()),
                        pa.array(best.scores[number], pa.int64()),
                    ],
                    names=["item", "item_id", "doc_id", "score"],
                )

    return postings.mapInArrow(run, "item int, item_id long, doc_id long, score long")


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 20, pass_terms: int = PASS_TERMS, block_docs: int = BLOCK_DOCS
) -> DataFrame:
    """The ``k`` best documents of every item as (item_id, rank, doc_id, score).

    Items are asked in passes of about ``pass_terms`` terms, which bounds what is
    broadcast. Every row of ``docs`` is a document and every row of ``items`` a
    question of its own, repeated rows included; rows with null texts, or without
    terms, have no ranks. A null doc_id comes last among equal scores; other columns
    are left out. Tasks keep ``k`` documents an item and one block of postings.
    """
    spark = docs.sparkSession
    asked = item_terms(items)
    passes = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // pass_terms)
    results = []
    for number in range(passes):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(passes)) == number).collect()
        if rows:
            results.append(_one_pass(docs, rows, k, block_docs))
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    ranked = results[0]
    for more in results[1:]:
        ranked = ranked.union(more)
    return ranked


def _one_pass(docs: DataFrame, rows: list[Row], k: int, block_docs: int) -> DataFrame:
    vocabulary = sorted({bytes(t) for row in rows for t in row["terms"]})
    postings = stored(term_counts(docs, vocabulary), "postings")
    filled = postings.where("n > 0").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    held = np.zeros(len(vocabulary), np.int64)
    for row in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        held[row["term"]] = row["count"]
    weights = np.array([floor(1000 * log((2 * filled["docs"] + 2) / (2 * n + 1))) for n in held.tolist()], np.int64)
    asked = questions(rows, {t: i for i, t in enumerate(vocabulary)}, weights)
    best = best_by_task(postings, asked, k, filled["docs"], filled["total"], block_docs)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
