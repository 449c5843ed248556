"""Packing token ids into sequences by multiway differencing.

Documents are cut into pieces; a batch of pieces is shared out over as many windows
as its tokens need. Every piece starts as a partition with one filled window; the two
partitions with the largest spread are merged, the fullest windows of one with the
emptiest of the other, until one is left, whose windows are nearly equal. If a window
exceeds the capacity the batch gets one window more and is shared out anew.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from dockspan.llm.batches import SPACES, ragged, tidy
from dockspan.llm.units import Encoder, encoded_slices

WINDOWS = 192
SMALLEST = 32
# Tokens a window that a batch leaves free, so that its first sharing out mostly fits.
ROOM = 28
# Sequence numbers: partition, then the number within it.
PARTITION_SHIFT = 36


def differencing(sizes: list[int], windows: int) -> np.ndarray:
    """Window of every piece, with nearly equal sums over the windows."""
    # A partition lists its filled windows, least first: their sums, lessened by the least once
    # all are filled, and one piece of each. Merging two windows hangs one's piece below the other's.
    parent = np.arange(len(sizes))
    heap = [(-size, i, np.array([size]), np.array([i])) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, sums, nodes = heapq.heappop(heap)
        _, _, other_sums, other_nodes = heapq.heappop(heap)
        # With empty windows at the low end of both rows, only this many filled windows meet.
        meet = max(0, len(sums) + len(other_sums) - windows)
        low, high, facing = slice(0, meet), slice(meet, None), slice(meet - 1, None, -1) if meet else slice(0, 0)
        facing_sums, facing_nodes = other_sums[facing], other_nodes[facing]
        parent[facing_nodes] = nodes[low]
        sums = np.concatenate([sums[low] + facing_sums, sums[high], other_sums[high]])
        nodes = np.concatenate([nodes, other_nodes[high]])
        order = sums.argsort(kind="stable")
        sums, nodes = sums[order], nodes[order]
        if len(sums) == windows:
            sums = sums - sums[0]
        heapq.heappush(heap, (-int(sums[-1]), serial, sums, nodes))
        serial += 1
    while True:
        above = parent[parent]
        if np.array_equal(above, parent):
            break
        parent = above
    window = np.zeros(len(sizes), np.int64)
    if heap:
        window[heap[0][3]] = np.arange(len(heap[0][3]))
    return window[parent]


def share_out(sizes: list[int], capacity: int) -> np.ndarray:
    """Window of every piece; the window count rises until no window exceeds the capacity.

    It starts where windows have room left, since nearly equal windows seldom all fit without.
    """
    total = sum(sizes)
    windows = max(1, -(-total // capacity), round(total / (capacity - ROOM)) if capacity > 2 * ROOM else 1)
    while True:
        own = differencing(sizes, windows)
        if np.bincount(own, weights=sizes).max(initial=0) <= capacity:
            return own
        windows += 1


def cut(size: int, capacity: int, smallest: int) -> list[int]:
    """Lengths of a document's pieces: full windows, then halves of what is left."""
    full, rest = divmod(size, capacity)
    pieces = [capacity] * full
    while rest > 2 * smallest:
        half = rest - rest // 2
        pieces.append(half)
        rest -= half
    return pieces + [rest] * (rest > 0)

# Bytes of text encoded at a time.
ENCODE_BYTES = 2 << 20


class Batch:
    """Pieces waiting for their windows."""

    def __init__(self, capacity: int):
        self.capacity, self.rows, self.sizes, self.tokens = capacity, [], [], 0

    def add(self, row: tuple, length: int) -> None:
        self.rows.append(row)
        self.sizes.append(length)
        self.tokens += length

    def placed(self, first: int) -> tuple[list[tuple], int]:
        """(row, sequence, offset) of every piece, and the next free sequence; the batch is empty then."""
        windows = np.unique(share_out(self.sizes, self.capacity), return_inverse=True)[1].tolist()
        filled = [0] * (max(windows) + 1)
        out = []
        for row, length, window in zip(self.rows, self.sizes, windows, strict=True):
            out.append((row, first + window, filled[window]))
            filled[window] += length
        self.rows, self.sizes, self.tokens = [], [], 0
        return out, first + len(filled)


# White space beyond a plain space that sorts above it.
WIDE = re.compile(f"[{SPACES[SPACES.index(' ') + 1 :]}]")


class JoinedUnits:
    """Ids of many units from one call over their joined text, cut where the units' bytes end.

    Units that start with a space and have no other white space at either end are encoded alike
    apart and together; the others are encoded one by one.
    """

    def __init__(self, encode, ranks: dict[bytes, int]):
        self.encode = encode
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for text, rank in ranks.items():
            self.sizes[rank] = len(text)

    def __call__(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units one after the other, and how many each has."""
        # What isn't above a space is white space or a control; wider white space is looked for once.
        joins = [u[:1] == " " and u[1:2] > " " and u[-1] > " " for u in units]
        if WIDE.search("".join(units)):
            joins = [own and not u[1].isspace() and not u[-1].isspace() for u, own in zip(units, joins, strict=True)]
        some = units if all(joins) else list(compress(units, joins))
        ids = np.array(self.encode("".join(some)), np.int32)
        wanted = np.cumsum(pc.binary_length(pa.array(some, pa.string())).to_numpy(zero_copy_only=False))
        edges = np.append(0, np.searchsorted(np.cumsum(self.sizes[ids]), wanted) + 1)
        if some is units:
            return ids, np.diff(edges)
        own = np.array(joins, bool)
        lists = [self.encode(units[i]) for i in np.flatnonzero(~own).tolist()]
        starts, lengths = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        starts[own], lengths[own] = edges[:-1], np.diff(edges)
        lengths[~own] = [len(x) for x in lists]
        starts[~own] = len(ids) + np.cumsum(lengths[~own]) - lengths[~own]
        return np.concatenate([ids, *[np.array(x, np.int32) for x in lists]])[ragged(starts, lengths)], lengths


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def fast_encoder(path: str, ranks_path: str, pattern: str) -> Encoder:
    """The file's own ids, computed from the same vocabulary as ranks."""
    if (path, ranks_path) not in _ENCODERS:
        import base64
        import json

        import regex
        import tiktoken

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        with open(path, encoding="utf-8") as file:
            special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        own = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        units = JoinedUnits(own.encode_ordinary, ranks)
        _ENCODERS[path, ranks_path] = Encoder(regex.compile(pattern).findall, units, special)
    return _ENCODERS[path, ranks_path]


def pack_documents(
    docs: DataFrame,
    path: str,
    ranks_path: str,
    pattern: str,
    capacity: int = 2048,
    end_id: int = 1,
    windows: int = WINDOWS,
    smallest: int = SMALLEST,
) -> DataFrame:
    """Pieces of all documents with their place in a sequence.

    Returns doc_id, start, length, ``ids`` (little-endian unsigned 32-bit), doc_tokens,
    sequence_id and offset. Every document ends with ``end_id``, so null and empty texts
    are one piece of one id. Batches of about ``windows`` windows are packed where their
    documents lie, so nothing is shuffled and no group grows; sequence numbers carry the
    number of the partition and are unique, with gaps. Repeated rows are packed as often
    as they come; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        following = (context.partitionId() if context else 0) << PARTITION_SHIFT
        waiting = Batch(capacity)

        for part, ids, edges in encoded_slices(batches, fast_encoder(path, ranks_path, pattern), ENCODE_BYTES):
            names = part.column("doc_id").to_pylist()
            for doc_id, a, b in zip(names, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own = np.append(ids[a:b], end_id).astype("<u4")
                start, full = 0, []
                for length in cut(len(own), capacity, smallest):
                    row = (doc_id, start, own[start : start + length].tobytes(), len(own))
                    start += length
                    if length == capacity:
                        full.append((row, following, 0))
                        following += 1
                        continue
                    if waiting.tokens + length > (capacity - ROOM if capacity > 2 * ROOM else capacity) * windows:
                        placed, following = waiting.placed(following)
                        yield as_batch(placed)
                    waiting.add(row, length)
                if full:
                    yield as_batch(full)
        if waiting.rows:
            placed, following = waiting.placed(following)
            yield as_batch(placed)

    return docs.select("doc_id", "text").mapInArrow(
        tidy(run), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )


def as_batch(placed: list[tuple]) -> pa.RecordBatch:
    rows = [row for row, _, _ in placed]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([len(r[2]) // 4 for r in rows], pa.int64()),
            pa.array([r[2] for r in rows], pa.binary()),
            pa.array([r[3] for r in rows], pa.int64()),
            pa.array([s for _, s, _ in placed], pa.int64()),
            pa.array([o for _, _, o in placed], pa.int64()),
        ],
        names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
    )
