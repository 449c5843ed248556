"""How often each token of a corpus follows its one and its two previous tokens.

Contexts are hashed: 40 bits for a token with the one before it, 16 more for the one before that.
A block of documents sends its distinct contexts with their counts to the parts of the hash's range,
where the counts of all blocks are added up and go back in the order in which they came. A block
works that order out again from its tokens, so neither places nor tokens travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from dockspan.llm.batches import tidy

PAIR_BITS, SECOND_BITS, WORD_BYTES = 40, 16, 5
# Before the first token of a text.
START = np.uint64(0x5851F42D4C957F2D)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(words: pa.Array) -> np.ndarray:
    """Hashes of ``WORD_BYTES`` bytes."""
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in words.cast(pa.binary()).to_pylist()], np.uint64) >> np.uint64(64 - 8 * WORD_BYTES)


def squeezed(data: bytes) -> bytes:
    """Compressed, after the length."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def restored(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def planes(values: np.ndarray, width: int) -> bytes:
    """Whole numbers below 256 ** width, compressed by the planes of their bytes."""
    return squeezed(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def from_planes(data: bytes, width: int) -> np.ndarray:
    held = np.frombuffer(restored(data), np.uint8).reshape(width, -1)
    out = np.zeros((held.shape[1], 8), np.uint8)
    out[:, :width] = held.T
    return out.view("<u8").ravel()


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _STEP) ^ (b * _MIX)
    x ^= x >> np.uint64(32)
    x *= _STEP
    return x ^ (x >> np.uint64(29))


class Contexts:
    """The contexts of a block's tokens: in ``order`` equal ones are neighbours, by rising hash."""

    def __init__(self, hashes: np.ndarray, tokens: np.ndarray, starts: np.ndarray):
        own = hashes[tokens]
        before = np.roll(own, 1)
        before[starts] = START
        second = np.roll(before, 1)
        second[starts] = 0
        key = mixed(before, own)
        del own, before
        key >>= np.uint64(64 - PAIR_BITS)
        key <<= np.uint64(SECOND_BITS)
        key |= mixed(second, np.full(1, START)) >> np.uint64(64 - SECOND_BITS)
        del second
        self.order = np.argsort(key, kind="stable").astype(np.int32)
        key = key[self.order]
        new = np.append(True, key[1:] != key[:-1])
        self.first = np.flatnonzero(new)
        self.kinds = key[self.first]
        pair = self.kinds >> np.uint64(SECOND_BITS)
        # Where the pairs begin among the kinds.
        self.pair_first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        self.pairs = pair[self.pair_first]

    def spread(self, pair_counts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every token the count of its pair and of its whole context, given those of pairs and kinds."""
        out = []
        each = np.repeat(pair_counts, np.diff(self.pair_first, append=len(self.kinds)))
        for values in (each, counts):
            found = np.empty(len(self.order), values.dtype)
            found[self.order] = np.repeat(values, np.diff(self.first, append=len(self.order)))
            out.append(found)
        return out[0], out[1]


def tokens_of(codes: bytes) -> np.ndarray:
    return from_planes(codes, 4).astype(np.int32)


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def sent(blocks: DataFrame, bits: int) -> DataFrame:
    """A row for each block and part, of 2 ** bits: pairs as steps, contexts of each pair, and their counts in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                row = {name: batch.column(name)[at] for name in batch.schema.names}
                lengths = row["n_tokens"].values.to_numpy()
                tokens = tokens_of(row["codes"].as_py())
                found = Contexts(word_hashes(row["words"].values), tokens, starts_of(lengths))
                training = np.repeat(~row["held_out"].values.to_numpy(zero_copy_only=False), lengths)
                counts = np.add.reduceat(training[found.order], found.first, dtype=np.int64)
                runs = np.diff(found.pair_first, append=len(found.kinds))
                limits = np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(PAIR_BITS - bits)
                edges = np.searchsorted(found.pairs, limits)
                inner = np.append(found.pair_first, len(found.kinds))[edges]
                parts = np.flatnonzero(np.diff(edges))
                out = {"part": parts, "block": np.full(len(parts), row["block"].as_py())}
                columns = {"pairs": [], "runs": [], "seconds": [], "counts": []}
                for part in parts.tolist():
                    pairs, kinds = slice(edges[part], edges[part + 1]), slice(inner[part], inner[part + 1])
                    columns["pairs"].append(planes(np.diff(found.pairs[pairs], prepend=limits[part]), 5))
                    columns["runs"].append(planes(runs[pairs], 4))
                    columns["seconds"].append((found.kinds[kinds] & np.uint64((1 << SECOND_BITS) - 1)).astype("<u2").tobytes())
                    columns["counts"].append(planes(counts[kinds], 4))
                yield pa.RecordBatch.from_pydict(out | {k: pa.array(v, pa.binary()) for k, v in columns.items()})

    fields = "part long, block long, pairs binary, runs binary, seconds binary, counts binary"
    return blocks.select("block", "held_out", "n_tokens", "codes", "words").mapInArrow(tidy(run), fields)


def added_up(key, table):
    """The counts of all blocks in one part, for each block in the order in which it sent its contexts."""
    keys, counts, pair_places, sizes = [], [], [], []
    base = key[0].as_py()
    for row in table.select(["pairs", "runs", "seconds", "counts"]).to_pylist():
        pairs = np.cumsum(from_planes(row["pairs"], 5), dtype=np.uint64)
        runs = from_planes(row["runs"], 4).astype(np.int64)
        seconds = np.frombuffer(row["seconds"], "<u2").astype(np.uint64)
        keys.append(np.repeat(pairs, runs) << np.uint64(SECOND_BITS) | seconds)
        counts.append(from_planes(row["counts"], 4).astype(np.int64))
        pair_places.append(starts_of(runs))
        sizes.append(len(seconds))
    kinds, which = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(which, weights=np.concatenate(counts), minlength=len(kinds)).astype(np.int64)
    pair = kinds >> np.uint64(SECOND_BITS)
    first = np.append(True, pair[1:] != pair[:-1])
    pair_totals = np.add.reduceat(totals, np.flatnonzero(first))[np.cumsum(first) - 1]
    out, at = {"part": [], "block": table.column("block"), "x": [], "y": []}, 0
    for places, size in zip(pair_places, sizes, strict=True):
        own = which[at : at + size]
        out["part"].append(base)
        out["x"].append(planes(pair_totals[own[places]], 5))
        out["y"].append(planes(totals[own], 5))
        at += size
    return pa.table(
        [pa.array(out["part"], pa.int64()), out["block"]]
        + [pa.array(out[c], pa.binary()) for c in "xy"],
        names=["part", "block", "x", "y"],
    )


def context_counts(blocks: DataFrame) -> DataFrame:
    """(part, block, x, y): counts in training documents of the block's pairs (x) and contexts (y) in each part."""
    bits = max(3, (2 * blocks.count() - 1).bit_length())
    return sent(blocks, min(bits, 24)).groupBy("part").applyInArrow(added_up, "part long, block long, x binary, y binary")


def counts_by_token(contexts: Contexts, rows: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of pair and context of every token from the rows (part, x, y) of its block."""
    rows = sorted(rows)
    pairs = np.concatenate([from_planes(x, 5) for _, x, _ in rows]).astype(np.int64)
    return contexts.spread(pairs, np.concatenate([from_planes(y, 5) for _, _, y in rows]).astype(np.int64))
