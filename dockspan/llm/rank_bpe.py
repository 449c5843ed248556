"""Byte-level BPE by ranks: overlapping chunks, stitched pre-tokens, pieces encoded apart.

A text is cut into chunks that read a little into the next one. Chunks are split
into pre-tokens apart from each other; a chunk that starts inside a pre-token gives
wrong ones at first. The splitter has no memory, so two chunks that share one
boundary agree from there on: the last boundary that a chunk is sure of is looked up
in the next chunk, and matched on until it is found there. What lies between two
such places is a piece, whose pre-tokens are encoded by ranks. Short texts are one
chunk and one piece and need no shuffle. Decoding joins the bytes of the ids.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from dockspan.llm.batches import UnitTable, binaries, ragged, slices, texts_of
from dockspan.llm.units import id_bytes

# Characters of a chunk, and of the following one that it also reads.
CHUNK, OVERLAP = 1 << 15, 1 << 8
# A match ends where it does whatever follows, if so many more characters are seen.
SEEN = 3
# Bytes of text, or of ids, worked on at a time; longer words merge by a heap.
ENCODE_BYTES, DECODE_BYTES, LONG_WORD = 2 << 20, 1 << 20, 48
UNITS_HELD = 200_000
NEVER = 1 << 60


class Spelling:
    """Bytes of every id, and their gathering for many id lists at once."""

    def __init__(self, spelled: list[bytes]):
        self.lengths = np.array([len(s) for s in spelled], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(spelled), np.uint8)

    def joined(self, ids: np.ndarray, edges: np.ndarray, skip: int = 0) -> pa.Array:
        """The bytes of every list, without the first ``skip`` bytes of its first id."""
        starts, lengths = self.starts[ids], self.lengths[ids]
        heads = edges[:-1][np.diff(edges) > 0]
        starts[heads] += skip
        lengths[heads] -= skip
        ends = np.concatenate([[0], np.cumsum(lengths)])[edges]
        return binaries(self.data[ragged(starts, lengths)], ends)


class RankBpe:
    """A rank file and the pattern that splits texts before merging."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            lines = [line.split() for line in file]
        self.ranks = {base64.b64decode(x[0]): int(x[1]) for x in lines if x}
        self.pattern = regex.compile(pattern)
        self.units = UnitTable(self.merge_all, UNITS_HELD)
        spelled = [b""] * (max(self.ranks.values()) + 1)
        for text, rank in self.ranks.items():
            spelled[rank] = text
        self.bytes = Spelling(spelled)
        self.decimals = Spelling([b" %d" % i for i in range(len(spelled))])
        self.bytes_alone = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        # The rank of a pair of ids is that of their joined bytes, however the merged token came about.
        pairs = {
            self.ranks[text[:at]] << 32 | self.ranks[text[at:]]: rank
            for text, rank in self.ranks.items()
            for at in range(1, len(text))
            if text[:at] in self.ranks and text[at:] in self.ranks
        }
        self.pairs = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[x] for x in self.pairs.tolist()], np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, ``NEVER`` where they don't merge."""
        asked = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, asked), len(self.pairs) - 1)
        return np.where(self.pairs[at] == asked, self.pair_ranks[at], NEVER)

    def merge_all(self, units: list[str]) -> Iterator[list[int]]:
        """Ids of many pre-tokens: short ones that are no token merge side by side, one pair each a round."""
        words = [u.encode() for u in units]
        some = [i for i, w in enumerate(words) if w not in self.ranks and len(w) <= LONG_WORD]
        merged = dict(zip(some, self._merge_short([words[i] for i in some]), strict=True)) if some else {}
        for i, word in enumerate(words):
            yield merged[i] if i in merged else self.merge(word)

    def _merge_short(self, words: list[bytes]) -> list[list[int]]:
        ids = self.bytes_alone[np.frombuffer(b"".join(words), np.uint8)]
        lengths = np.array([len(w) for w in words], np.int64)
        number = np.arange(len(words))
        rank = np.full(len(ids), NEVER)
        rank[:-1] = self.pair_rank(ids[:-1], ids[1:])
        rank[np.cumsum(lengths) - 1] = NEVER
        done = []
        while len(number):
            starts = np.cumsum(lengths) - lengths
            least = np.minimum.reduceat(rank, starts)
            over = least == NEVER
            if over.any():
                own = np.repeat(over, lengths)
                done.append((number[over], ids[own], lengths[over]))
                ids, rank, lengths, number, least = ids[~own], rank[~own], lengths[~over], number[~over], least[~over]
                if not len(number):
                    break
                starts = np.cumsum(lengths) - lengths
            equal = np.flatnonzero(rank == np.repeat(least, lengths))
            at = equal[np.searchsorted(equal, starts)]
            ids[at] = least
            # What follows the merged pair now follows the new token.
            ends = starts + lengths
            after = np.flatnonzero(at + 2 < ends)
            rank[at] = NEVER
            rank[at[after]] = self.pair_rank(least[after], ids[at[after] + 2])
            before = np.flatnonzero(at > starts)
            rank[at[before] - 1] = self.pair_rank(ids[at[before] - 1], least[before])
            kept = np.ones(len(ids), bool)
            kept[at + 1] = False
            ids, rank, lengths = ids[kept], rank[kept], lengths - 1
        out: list[list[int]] = [[]] * len(words)
        for own, flat, sizes in done:
            ends = np.cumsum(sizes).tolist()
            flat = flat.tolist()
            for i, start, end in zip(own.tolist(), [0, *ends], ends, strict=False):
                out[i] = flat[start:end]
        return out

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: of all neighbours the pair of least rank merges first, the leftmost of equals."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        if len(word) > LONG_WORD:
            return self._merge_long(word)
        get = self.ranks.get
        parts = [word[i : i + 1] for i in range(len(word))]
        pairs = [get(word[i : i + 2], NEVER) for i in range(len(word) - 1)]
        while pairs and (least := min(pairs)) < NEVER:
            at = pairs.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = get(parts[at - 1] + parts[at], NEVER)
            if at < len(pairs):
                pairs[at] = get(parts[at] + parts[at + 1], NEVER)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, word: bytes) -> list[int]:
        size, get = len(word), self.ranks.get
        ends = array("q", range(1, size + 1))
        before = array("q", range(-1, size - 1))
        gone = bytearray(size)
        # An offer holds the pair's rank above 40 bits of its place; a stale one has another rank by now.
        offers = [get(word[i : i + 2], NEVER) << 40 | i for i in range(size - 1)]
        offers = [x for x in offers if x >> 40 < NEVER]
        heapq.heapify(offers)

        def rank(at: int) -> int:
            middle = ends[at]
            return get(word[at : ends[middle]], NEVER) if middle < size else NEVER

        while offers:
            least, at = divmod(heapq.heappop(offers), 1 << 40)
            if gone[at] or rank(at) != least:
                continue
            middle = ends[at]
            gone[middle] = 1
            ends[at] = ends[middle]
            if ends[at] < size:
                before[ends[at]] = at
            for place in (at, before[at]):
                if place >= 0 and (found := rank(place)) < NEVER:
                    heapq.heappush(offers, found << 40 | place)
        return [self.ranks[word[i : ends[i]]] for i in range(size) if not gone[i]]

    def ids(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lists of pre-tokens one after the other, and where each list's ids start."""
        flat = [u for units in texts for u in units]
        places = {u: i for i, u in enumerate(dict.fromkeys(flat))}
        codes = np.fromiter(map(places.__getitem__, flat), np.int64, len(flat))
        starts, lengths = self.units.look_up(list(places))
        starts, lengths = starts[codes], lengths[codes]
        ids = self.units.flat[ragged(starts, lengths)]
        edges = np.concatenate([[0], np.cumsum([len(units) for units in texts])]).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(lengths)])[edges]


_MODELS: dict[tuple[str, str], RankBpe] = {}


def model(path: str, pattern: str) -> RankBpe:
    """The model of a file, built once in each worker process."""
    if (path, pattern) not in _MODELS:
        _MODELS[path, pattern] = RankBpe(path, pattern)
    return _MODELS[path, pattern]


def cut_chunks(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Chunks (key, no, start, text, last) of texts (key, text), each reading ``overlap`` characters on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                starts = range(0, max(len(text), 1), chunk)
                for at in range(0, len(starts), 64):
                    own = starts[at : at + 64]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "key": pa.array([key] * len(own), pa.string()),
                            "no": pa.array([s // chunk for s in own], pa.int64()),
                            "start": pa.array(own, pa.int64()),
                            "text": pa.array([text[s : s + chunk + overlap] for s in own], pa.string()),
                            "last": pa.array([s + chunk >= len(text) for s in own], pa.bool_()),
                        }
                    )

    return texts.select("key", "text").mapInArrow(run, "key string, no long, start long, text string, last boolean")


def find_pre_tokens(chunks: DataFrame, path: str, pattern: str) -> DataFrame:
    """Add ``lengths``, the characters of the pre-tokens whose end is sure; of a last chunk all are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = model(path, pattern).pattern
        for batch in batches:
            for part in slices(batch, "text", ENCODE_BYTES):
                found = []
                for text, last in zip(part.column("text").to_pylist(), part.column("last").to_pylist(), strict=True):
                    lengths = np.fromiter(map(len, split.findall(text)), np.int32)
                    sure = np.cumsum(lengths) <= (len(text) if last else len(text) - SEEN)
                    found.append(lengths[sure])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(found, pa.list_(pa.int32()))], names=[*part.schema.names, "lengths"]
                )

    fields = ", ".join(f"{name} {kind}" for name, kind in chunks.dtypes)
    return chunks.mapInArrow(run, f"{fields}, lengths array<int>")


class Stitcher:
    """Pieces of one text from its chunks in order; ``place`` is the last boundary that is sure."""

    def __init__(self, split: regex.Pattern):
        self.split = split
        self.place, self.tail = 0, ""

    def piece(self, start: int, text: str, lengths: np.ndarray, last: bool) -> tuple[str, np.ndarray]:
        """Text and pre-token lengths from the last sure boundary to the chunk's own last one."""
        bounds = start + np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        known = self.tail + text[self.place + len(self.tail) - start :]
        limit = len(known) - (0 if last else SEEN)
        at, stepped = 0, []
        while True:
            same = int(np.searchsorted(bounds, self.place + at))
            if same < len(bounds) and bounds[same] == self.place + at:
                own = np.concatenate([stepped, lengths[same:]]).astype(np.int32)
                break
            match = self.split.match(known, at)
            if match is None or match.end() > limit:
                own = np.array(stepped, np.int32)
                break
            stepped.append(match.end() - at)
            at = match.end()
        end = int(own.sum())
        self.place, self.tail = self.place + end, known[end:]
        return known[:end], own


def stitch(chunks: DataFrame, path: str, pattern: str) -> DataFrame:
    """Pieces (key, no, text, lengths) of texts whose chunks have pre-tokens; ids of the pieces join to the text's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = model(path, pattern).pattern
        current, stitcher = None, Stitcher(split)
        for batch in batches:
            for part in slices(batch, "text", ENCODE_BYTES):
                pieces = []
                columns = [part.column(x).to_pylist() for x in ("key", "start", "text", "last")]
                for key, start, text, last, lengths in zip(*columns, part.column("lengths"), strict=True):
                    if key != current:
                        current, stitcher = key, Stitcher(split)
                    pieces.append(stitcher.piece(start, text, lengths.values.to_numpy(), last))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"),
                        part.column("no"),
                        pa.array([text for text, _ in pieces], pa.string()),
                        pa.array([lengths for _, lengths in pieces], pa.list_(pa.int32())),
                    ],
                    names=["key", "no", "text", "lengths"],
                )

    ordered = chunks.repartition("key").sortWithinPartitions("key", "no")
    return ordered.mapInArrow(run, "key string, no long, text string, lengths array<int>")


def encode_pieces(pieces: DataFrame, path: str, pattern: str) -> DataFrame:
    """(key, no, ids) of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path, pattern)
        for batch in batches:
            for part in slices(batch, "text", ENCODE_BYTES):
                units = []
                for text, lengths in zip(part.column("text").to_pylist(), part.column("lengths").to_pylist(), strict=True):
                    ends = np.cumsum(lengths, dtype=np.int64).tolist()
                    units.append([text[a:b] for a, b in zip([0, *ends], ends, strict=False)])
                ids, edges = bpe.ids(units)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("no"), id_bytes(ids, edges)], names=["key", "no", "ids"]
                )

    return pieces.repartition("key", "no").mapInArrow(run, "key string, no long, ids binary")


def encode_short(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of texts of one chunk each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path, pattern)
        for batch in batches:
            for part in slices(batch, "text", ENCODE_BYTES):
                texts = texts_of(part.column("text")).to_pylist()
                ids, edges = bpe.ids([bpe.pattern.findall(text) for text in texts])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), id_bytes(ids, edges)], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def encode_texts(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Ids of every whole text as doc_id, n_tokens and ``ids`` (little-endian unsigned 32-bit).

    ``path`` names a rank file that every worker must have. No string is special.
    Null and empty texts have no ids; rows repeat as they come; other columns are
    left out. Texts of over ``chunk`` bytes are cut into chunks, equal ones once.
    The memory of a task is bounded by one text, as a row must be, and about 60
    times the longest pre-token.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    rows = docs.select("doc_id", "text")
    short = encode_short(rows.where(size <= chunk), path, pattern)
    long = rows.where(size > chunk).withColumn("key", F.sha2("text", 256))
    chunks = cut_chunks(long.dropDuplicates(["key"]), chunk, overlap).repartition("key", "no")
    pieces = stitch(find_pre_tokens(chunks, path, pattern), path, pattern)
    coded = encode_pieces(pieces, path, pattern).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("no", "ids"))).alias("all"))
    joined = F.unhex(F.array_join(F.transform("all", lambda x: F.hex(x["ids"])), ""))
    whole = long.select("doc_id", "key").join(coded.select("key", joined.alias("ids")), "key").select("doc_id", "ids")
    return short.union(whole).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def decode_ids(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """Add ``decoded``, the bytes of ``ids``, and ``decimals``, the ids as decimals between spaces.

    A null list gives empty values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path, pattern)
        for batch in batches:
            for part in slices(batch, "ids", DECODE_BYTES):
                lists = part.column("ids").fill_null(b"").to_pylist()
                ids = np.frombuffer(b"".join(lists), "<u4")
                edges = np.concatenate([[0], np.cumsum([len(x) // 4 for x in lists])]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, bpe.bytes.joined(ids, edges), bpe.decimals.joined(ids, edges, 1).cast(pa.string())],
                    names=[*part.schema.names, "decoded", "decimals"],
                )

    fields = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)
    return rows.mapInArrow(run, f"{fields}, decoded binary, decimals string")
