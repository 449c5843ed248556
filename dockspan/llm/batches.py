"""Arrow helpers that run inside tasks: slices of bounded bytes, ragged gathers, cached units."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20
# Units whose numbers are lists at a time.
ADDED = 4096

# White space as Unicode defines it, for RE2 and for Python's re alike.
SPACES = "\t-\r \x85\xa0  -     　"


def give_back() -> None:
    """Return freed memory to the system; a worker keeps it while it waits for its next task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """``run`` over batches, with freed memory given back at the end of the task."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one array of strings; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts together stay near ``limit`` bytes; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if row > start and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if len(sizes) > start:
        yield batch.slice(start)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every range, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - ends + lengths, lengths)


def sums_by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values[offsets[i]:offsets[i + 1]]`` for every row, empty rows included."""
    running = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return running[offsets[1:]] - running[offsets[:-1]]


def binaries(data: np.ndarray, byte_offsets: np.ndarray) -> pa.Array:
    """Byte ranges of one buffer as a binary column, without copying."""
    return pa.Array.from_buffers(
        pa.binary(),
        len(byte_offsets) - 1,
        [None, pa.py_buffer(byte_offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))],
    )


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space of all texts, and where each text's words start."""
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy()
    words = lists.flatten()
    offsets = offsets - offsets[0]
    filled = pc.not_equal(pc.binary_length(words), 0)
    if not pc.all(filled).as_py():
        counts = sums_by_row(filled.to_numpy(zero_copy_only=False).astype(np.int64), offsets)
        words = words.filter(filled)
        offsets = np.concatenate([[0], np.cumsum(counts)])
    return words, offsets


class UnitTable:
    """Short lists of numbers by string, computed once while they are held.

    ``compute`` turns new strings into lists of ints, or into one array of all ints and one of
    their counts. A full table keeps the strings
    that were asked for more than once, if they are few enough, so its memory is
    bounded; results don't depend on it.
    """

    def __init__(self, compute, limit: int = 250_000):
        self.compute, self.limit = compute, limit
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.int32)
        self.starts = np.zeros(1 << 12, np.int64)
        self.uses = np.zeros(1 << 12, np.int64)

    def shrink(self) -> None:
        kept = np.flatnonzero(self.uses[: len(self.places)] > 1)
        if len(kept) > self.limit // 2:
            self.clear()
            return
        often = set(kept.tolist())
        names = [unit for unit, place in self.places.items() if place in often]
        lengths = self.starts[kept + 1] - self.starts[kept]
        flat = self.flat[ragged(self.starts[kept], lengths)]
        self.clear()
        self.places = {unit: place for place, unit in enumerate(names)}
        self.flat = np.concatenate([flat, self.flat])
        self.starts = np.concatenate([[0], np.cumsum(lengths), self.starts])
        self.uses = np.zeros(len(self.starts), np.int64)

    def _add(self, units: list[str]) -> None:
        """Compute distinct new strings and put their numbers behind those that are held."""
        computed = self.compute(units)
        if isinstance(computed, tuple):
            numbers, counts = computed
        else:
            lists = list(computed)
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            numbers = np.fromiter(chain.from_iterable(lists), np.int32, int(counts.sum()))
        first, at = len(self.places), int(self.starts[len(self.places)])
        ends = at + np.cumsum(counts)
        last, end = first + len(units), int(ends[-1])
        if last >= len(self.starts):
            more = np.zeros(max(len(self.starts), last), np.int64)
            self.starts, self.uses = np.concatenate([self.starts, more]), np.concatenate([self.uses, more])
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(len(self.flat), end - at), np.int32)])
        self.flat[at:end] = numbers
        self.starts[first + 1 : last + 1] = ends
        self.places.update(zip(units, range(first, last)))

    def look_up(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where every unit's numbers start in ``flat``, and how many they are."""
        if len(self.places) > self.limit:
            self.shrink()
        get = self.places.get
        found = np.fromiter(map(get, units, repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = [units[i] for i in missing.tolist()]
            distinct = list(dict.fromkeys(new))
            for at in range(0, len(distinct), ADDED):
                self._add(distinct[at : at + ADDED])
            found[missing] = [self.places[u] for u in new]
        self.uses[found] += 1
        starts = self.starts[found]
        return starts, self.starts[found + 1] - starts
