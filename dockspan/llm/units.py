"""Texts as byte-level BPE ids, from units that the splitter never joins.

A unit is a piece of text between spaces, with the space before it. A cut before
a space is safe unless white space stands on both sides of it, and special strings
are cut out first; the few texts with such runs of white space are split by the
tokenizer's own pattern. Equal units of a batch are encoded once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from dockspan.llm.batches import SLICE_BYTES, SPACES, UnitTable, binaries, ragged, slices, sums_by_row, texts_of

# White space that a plain cut at spaces would split from its neighbours.
RUNS = f"[{SPACES}] (?:[{SPACES}]|$)"


class Encoder:
    """Ids of whole texts, given ``pieces`` (text to units) and ``encode`` (units to lists of ids)."""

    def __init__(self, pieces, encode, special: dict[str, int], held: int = 250_000):
        self.pieces, self.special = pieces, special
        self.table = UnitTable(encode, held)

    def ids_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids start."""
        slow = pc.match_substring_regex(texts, RUNS)
        for string in self.special:
            slow = pc.or_(slow, pc.match_substring(texts, string))
        plain = pc.if_else(slow, "", texts)
        lists = pc.split_pattern(plain, " ")
        offsets = lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        words = coded.dictionary.to_pylist()
        heads = offsets[:-1]
        first = codes[heads]
        later = np.ones(len(codes), bool)
        later[heads] = False
        kinds = np.unique(first)
        tails = np.unique(codes[later])
        starts = np.zeros(2 * len(words), np.int64)
        lengths = np.zeros(2 * len(words), np.int64)
        asked = [words[i] for i in kinds.tolist()] + [" " + words[i] for i in tails.tolist()]
        places = np.concatenate([kinds, tails + len(words)])
        starts[places], lengths[places] = self.table.look_up(asked)
        codes = codes + np.where(later, len(words), 0)
        flat = self.table.flat
        by_unit = lengths[codes]
        ids = flat[ragged(starts[codes], by_unit)]
        counts = sums_by_row(by_unit, offsets)
        rows = np.flatnonzero(slow.to_numpy(zero_copy_only=False))
        if len(rows):
            ids, counts = self._insert(ids, counts, rows, texts)
        return ids, np.concatenate([[0], np.cumsum(counts)])

    def _insert(self, ids, counts, rows, texts):
        edges = np.concatenate([[0], np.cumsum(counts)])
        parts, done = [], 0
        for row in rows.tolist():
            own = self.whole(texts[row].as_py())
            parts += [ids[done : edges[row]], own]
            done = edges[row + 1]
            counts[row] = len(own)
        return np.concatenate([*parts, ids[done:]]), counts

    def whole(self, text: str) -> np.ndarray:
        """Ids of one text by the splitter itself."""
        parts = [np.empty(0, np.int32)]
        for piece, special in self._specials(text, list(self.special)):
            if special:
                parts.append(np.array([self.special[piece]], np.int32))
            elif piece:
                units = self.pieces(piece)
                for at in range(0, len(units), 1 << 16):
                    starts, lengths = self.table.look_up(units[at : at + (1 << 16)])
                    parts.append(self.table.flat[ragged(starts, lengths)])
        return np.concatenate(parts)

    def _specials(self, text: str, strings: list[str]) -> Iterator[tuple[str, bool]]:
        if not strings:
            yield text, False
            return
        for i, piece in enumerate(text.split(strings[0])):
            if i:
                yield strings[0], True
            yield from self._specials(piece, strings[1:])


def encoded_slices(batches: Iterator[pa.RecordBatch], encoder: Encoder, limit: int = SLICE_BYTES):
    """(rows, ids, id offsets) for slices of bounded bytes with columns doc_id and text."""
    for batch in batches:
        for part in slices(batch, "text", limit):
            ids, edges = encoder.ids_of(texts_of(part.column("text")))
            yield part, ids, edges


def id_bytes(ids: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Ids as little-endian unsigned 32-bit integers, one binary value per text."""
    return binaries(ids.astype("<u4"), edges * 4)
