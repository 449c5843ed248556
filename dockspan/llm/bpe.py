"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a word has exactly one last token in its BPE encoding. An automaton
over the vocabulary gives all tokens that end at a position; the last token is the
one that is compatible with the last token of the prefix before it. Following these
back-pointers from the end gives the ids. Two neighbours are compatible when no
merge across their border comes before the merges that build them, which is tested
along the edges of their merge trees and remembered.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from dockspan.llm.batches import binaries, ragged, slices
from dockspan.llm.units import Encoder, encoded_slices, id_bytes

# Fixed value: the splitting pattern of this family of tokenizers.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NEVER = 1 << 60
PAIRS_HELD = 250_000
# Bytes of text, or of ids, worked on at a time, and units held.
ENCODE_BYTES, DECODE_BYTES = 2 << 20, 1 << 20
UNITS_HELD = 150_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for every byte in the vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {chr(b): b for b in plain}
    others = (b for b in range(256) if b not in set(plain))
    return letters | {chr(256 + i): b for i, b in enumerate(others)}


class PrefixBpe:
    """Exact ids of a vocabulary file with ranked merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model = described["model"]
        letters = byte_letters()
        spelled = {token: "".join(chr(letters[c]) for c in token) for token in model["vocab"] if all(c in letters for c in token)}
        ids = {spelled[t]: i for t, i in model["vocab"].items() if t in spelled}
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        size = max(max(ids.values()), *self.special.values()) + 1
        self.spelling = [b""] * size
        for text, i in ids.items():
            self.spelling[i] = text.encode("latin-1")
        for text, i in self.special.items():
            self.spelling[i] = text.encode()
        self.joined: dict[tuple[int, int], tuple[int, int]] = {}
        self.split: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (ids[spelled[x]] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            whole = ids[spelled[model_token(pair)]]
            self.joined[a, b] = (rank, whole)
            self.split.setdefault(whole, (rank, a, b))
        self.matches = ahocorasick.Automaton()
        for text, i in ids.items():
            if len(text) == 1 or i in self.split:
                self.matches.add_word(text, (i, len(text)))
        self.matches.make_automaton()
        self.single = ids
        self.known: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.pattern = regex.compile(SPLIT)

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The token's outer parts, from one byte up, each with the rank at which it is merged away."""
        found = self.edges.get((token, side))
        if found is None:
            part, until, parts = token, NEVER, []
            while part in self.split:
                parts.append((part, until))
                until, *halves = self.split[part]
                part = halves[side]
            parts.append((part, until))
            found = self.edges[token, side] = parts[::-1]
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their bytes are merged together."""
        if len(self.known) > PAIRS_HELD:
            self.known.clear()
        found = self.known[left << 32 | right] = self._stay_apart(self.edge(left, 1), self.edge(right, 0))
        return found

    def _stay_apart(self, lefts, rights) -> bool:
        i = j = 0
        while True:
            (a, a_until), (b, b_until) = lefts[i], rights[j]
            across = self.joined.get((a, b), (NEVER,))[0]
            # Of equal ranks the leftmost merges first: a's own merge before this one, this one before b's.
            if across < a_until and across <= b_until and across < NEVER:
                return False
            if a_until == NEVER and b_until == NEVER:
                return True
            if a_until <= b_until:
                i += 1
            else:
                j += 1

    def word(self, spelled: str) -> list[int]:
        """Ids of one word, given as one character per byte."""
        whole = self.single.get(spelled)
        if whole is not None and (len(spelled) == 1 or whole in self.split):
            return [whole]
        size = len(spelled)
        last, length = [0] * size, [0] * size
        known, compatible = self.known, self.compatible
        for end, (token, n) in self.matches.iter(spelled):
            if length[end]:
                continue
            start = end - n
            if start >= 0:
                if not length[start]:
                    continue
                fits = known.get(last[start] << 32 | token)
                if fits is None:
                    fits = compatible(last[start], token)
                if not fits:
                    continue
            last[end], length[end] = token, n
        out, end = [], size - 1
        while end >= 0:
            out.append(last[end])
            end -= length[end]
        return out[::-1]

    def unit(self, text: str) -> list[int]:
        words = self.pattern.findall(text)
        if len(words) == 1:
            return self.word(text.encode().decode("latin-1"))
        return [i for w in words for i in self.word(w.encode().decode("latin-1"))]

    def encoder(self) -> Encoder:
        return Encoder(self.pattern.findall, lambda units: map(self.unit, units), self.special, UNITS_HELD)


def model_token(pair) -> str:
    return "".join(pair) if isinstance(pair, list) else pair.replace(" ", "")


class Decoder:
    """Bytes of many id lists at once."""

    def __init__(self, spelling: list[bytes]):
        self.lengths = np.array([len(s) for s in spelling], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(spelling), np.uint8)

    def texts(self, ids: np.ndarray, edges: np.ndarray) -> pa.Array:
        """One text per list; bytes that are not UTF-8 become replacement characters."""
        by_id = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(by_id)])[edges]
        raw = binaries(self.data[ragged(self.starts[ids], by_id)], ends)
        try:
            return raw.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


_MODELS: dict[str, tuple[PrefixBpe, Encoder, Decoder]] = {}


def model(path: str) -> tuple[PrefixBpe, Encoder, Decoder]:
    """The model of a file, built once in each worker process."""
    if path not in _MODELS:
        bpe = PrefixBpe(path)
        _MODELS[path] = (bpe, bpe.encoder(), Decoder(bpe.spelling))
    return _MODELS[path]


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """Ids of every whole text as doc_id, n_tokens and ``ids`` (little-endian unsigned 32-bit).

    Special strings in a text become their special ids. Null and empty texts have
    no ids; rows repeat as they come; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, edges in encoded_slices(batches, model(path)[1], ENCODE_BYTES):
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(edges), pa.int64()), id_bytes(ids, edges)],
                names=["doc_id", "n_tokens", "ids"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode_ids(rows: DataFrame, path: str) -> DataFrame:
    """Add ``decoded``, the text of ``ids``; a null list gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = model(path)[2]
        for batch in batches:
            for part in slices(batch, "ids", DECODE_BYTES):
                lists = part.column("ids").fill_null(b"").to_pylist()
                ids = np.frombuffer(b"".join(lists), "<u4")
                edges = np.concatenate([[0], np.cumsum([len(x) // 4 for x in lists])]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, decoder.texts(ids, edges)], names=[*part.schema.names, "decoded"]
                )

    fields = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)
    return rows.mapInArrow(run, f"{fields}, decoded string")
