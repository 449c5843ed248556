"""Removal of long repeats with run-length BWT indexes.

Every window of ``length`` bytes has one anchor: the least hash of its short strings.
Equal windows have equal anchors at equal offsets, so only texts around equal anchors
need comparing. Neighbouring windows with one anchor form a context. Contexts that are
equal as a whole are counted; the others of an anchor go into an index: their suffixes are
sorted, the Burrows-Wheeler transform is cut into runs, the longest matches with the sorted
neighbours are measured at the ends of runs only, and streaming through the text gives the
longest match of every position from the last measured one.

Passages of a number of words are found in the same way in texts of word codes, whose bytes
are hashes of the words; only windows that start with a word count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from dockspan.llm.batches import binaries, ragged, slices, texts_of, tidy, words_of
from dockspan.llm.simhash import runs_of_key
from dockspan.llm.tables import keyed, stored

ANCHOR = 96
BYTES = 256
# Contexts are indexed together up to the first size. An anchor with more text than that is
# compared offset by offset, and beyond the second size its windows are counted by a shuffle.
INDEX_BYTES = 3 << 17
GROUP_BYTES = 1 << 25
# Texts are worked on in slices of this size; what is computed from them takes far more memory.
SMALL = 1 << 20
# Bytes of a word's code where passages are counted in words.
CODE = 5
WORD = re.compile(rb"[^\t-\r ]+")
CONTEXT_FIELDS = "__id long, __hash long, start int, windows int, offset int, anchor long, digest long"

_BASE = 0x9E3779B97F4A7C15 | 1
_VALUES = np.random.default_rng(42).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = []


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < size:
        size = max(size, 1 << 20)
        inverse = pow(_BASE, -1, 1 << 64)
        both = []
        for base in (_BASE, inverse):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _POWERS[:] = both
    return _POWERS[0][:size], _POWERS[1][:size]


def string_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from every position on, from running sums modulo 2**64."""
    up, down = powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * up[: len(data)], dtype=np.uint64)])
    hashes = (sums[size:] - sums[:-size]) * down[: len(data) - size + 1]
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    return hashes ^ (hashes >> np.uint64(29))


def least_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of ``width`` hashes from every position on; the first of equal ones."""
    keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    rows = -(-len(keys) // width)
    block = np.full(rows * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    block[: len(keys)] = keys
    block = block.reshape(rows, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(keys) - width + 1
    return (np.minimum(behind[:count], ahead[width - 1 : width - 1 + count]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def contexts_of(texts: pa.Array, length: int) -> dict[str, np.ndarray]:
    """Contexts of all texts: row, start in the text, windows, anchor and its offset, digest."""
    edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = texts.buffers()[2]
    raw = memoryview(body)[edges[0] : edges[-1]] if body is not None else memoryview(b"")
    data, edges = np.frombuffer(raw, np.uint8), edges - edges[0]
    counts = np.maximum(np.diff(edges) - length + 1, 0)
    windows = ragged(edges[:-1], counts)
    if not len(windows):
        return {name: np.empty(0, np.int64) for name in ("row", "start", "windows", "anchor", "offset", "digest")}
    anchor = min(ANCHOR, length)
    hashes = string_hashes(data, anchor)
    places = least_places(hashes, length - anchor + 1)[windows]
    fresh = np.ones(len(windows), bool)
    fresh[1:] = (places[1:] != places[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(fresh)
    sizes = np.diff(np.append(first, len(windows)))
    starts = windows[first]
    row = np.searchsorted(edges, starts, side="right") - 1
    digest = xxhash.xxh3_64_intdigest
    spans = zip(starts.tolist(), (starts + sizes + length - 1).tolist(), strict=True)
    return {
        "row": row,
        "start": starts - edges[row],
        "windows": sizes,
        "anchor": hashes[places[first]].view(np.int64),
        "offset": places[first] - starts,
        "digest": np.fromiter((digest(raw[a:b]) for a, b in spans), np.uint64, len(first)).view(np.int64),
    }


class RunLengthIndex:
    """Sorted suffixes of contexts, kept as BWT runs with sampled ends.

    Every context ends with a symbol of its own, so no match goes beyond it and all suffixes differ.
    """

    def __init__(self, contexts: list[bytes]):
        symbols = [np.frombuffer(c, np.uint8) for c in contexts]
        lengths = np.array([len(c) + 1 for c in contexts])
        self.starts = np.cumsum(lengths) - lengths
        self.text = np.empty(int(lengths.sum()), np.int64)
        for i, (start, own) in enumerate(zip(self.starts.tolist(), symbols, strict=True)):
            self.text[start : start + len(own)] = own
            self.text[start + len(own)] = BYTES + i
        self._sort(BYTES + len(contexts))
        before = np.where(self.order > 0, self.text[self.order - 1], -1)
        change = np.flatnonzero(before[1:] != before[:-1]) + 1
        # Sampled run ends: text places of the first and last suffix of every run.
        self.heads = np.concatenate([[0], change])
        self.tails = np.concatenate([change - 1, [len(before) - 1]])

    def _sort(self, symbols: int) -> None:
        """Order of the suffixes by doubling, from as many symbols as one key holds."""
        size, bits = len(self.text), symbols.bit_length()
        self.first = reach = 62 // bits
        padded = np.concatenate([self.text, np.full(reach, symbols)])
        key = np.zeros(size, np.int64)
        for step in range(reach):
            key = key << bits | padded[step : step + size]
        self.levels: list[tuple[int, np.ndarray]] = []
        while True:
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            rank = np.empty(size, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
            self.levels.append((reach, rank.astype(np.int32)))
            if rank[order[-1]] == size - 1:
                self.order = order
                return
            later = np.full(size, size)
            later[: max(size - reach, 0)] = rank[reach:]
            key = rank << 32 | later
            reach *= 2

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common beginning of the suffixes at a and b, from the sorting's own ranks."""
        size = len(self.text)
        total = np.zeros(len(a), np.int64)
        for reach, rank in reversed(self.levels):
            x, y = a + total, b + total
            inside = (x < size) & (y < size)
            same = np.zeros(len(a), bool)
            same[inside] = rank[x[inside]] == rank[y[inside]]
            total += np.where(same, reach, 0)
        for _ in range(self.first):
            x, y = a + total, b + total
            inside = (x < size) & (y < size)
            same = np.zeros(len(a), bool)
            same[inside] = self.text[x[inside]] == self.text[y[inside]]
            total += same
        return total

    def _streamed(self, ends: np.ndarray, neighbour: int) -> np.ndarray:
        """Match with one sorted neighbour at every text place, measured at run ends only."""
        size = len(self.text)
        measured = np.zeros(size, np.int64)
        inner = ends[(ends + neighbour >= 0) & (ends + neighbour < size)]
        measured[self.order[inner]] = self.common(self.order[inner], self.order[inner + neighbour])
        last = np.zeros(size, np.int64)
        last[self.order[ends]] = self.order[ends]
        last = np.maximum.accumulate(last)
        return measured[last] - (np.arange(size) - last)

    def longest_matches(self) -> np.ndarray:
        """Matching statistics of the text against all its other places."""
        return np.maximum(self._streamed(self.heads, -1), self._streamed(self.tails, 1))


def intervals(held: np.ndarray) -> np.ndarray:
    """Starts and ends of the true stretches, as int32 pairs."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], held, [False]]).astype(np.int8)))
    return edges.astype("<i4")


def repeated_by_index(contexts: list[bytes], length: int) -> list[np.ndarray]:
    index = RunLengthIndex(contexts)
    held = index.longest_matches() >= length
    return [held[s : s + len(c) - length + 1] for s, c in zip(index.starts.tolist(), contexts, strict=True)]


def repeated_by_offset(contexts: list[bytes], offsets: np.ndarray, length: int) -> list[np.ndarray]:
    """The same for one anchor with much text: windows at one offset of the anchor, one offset at a time."""
    held = [np.zeros(len(c) - length + 1, bool) for c in contexts]
    counts = np.array([len(h) for h in held])
    digest = xxhash.xxh3_128_digest
    for offset in range(int((offsets - counts + 1).min()), int(offsets.max()) + 1):
        at = offsets - offset
        own = np.flatnonzero((at >= 0) & (at < counts))
        seen: dict[bytes, int] = {}
        for i, a in zip(own.tolist(), at[own].tolist(), strict=True):
            other = seen.setdefault(digest(contexts[i][a : a + length]), i)
            if other != i:
                held[i][a] = held[other][int(offsets[other]) - offset] = True
    return held


def all_contexts(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SMALL):
                texts = part.column("text")
                found = contexts_of(texts if pa.types.is_binary(texts.type) else texts_of(texts), length)
                row = pa.array(found["row"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("__id").take(row), part.column("__hash").take(row)]
                    + [pa.array(found[c].astype(np.int32)) for c in ("start", "windows", "offset")]
                    + [pa.array(found[c]) for c in ("anchor", "digest")]
                    + [pa.array(places_among_equals(found["anchor"]))],
                    names=["__id", "__hash", "start", "windows", "offset", "anchor", "digest", "nth"],
                )

    return docs.select("__id", "__hash", "text").mapInArrow(tidy(run), f"{CONTEXT_FIELDS}, nth int")


def places_among_equals(values: np.ndarray) -> np.ndarray:
    """0, 1, ... for the values that occur several times, -1 for the others."""
    order = np.argsort(values, kind="stable")
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[order[1:]] != values[order[:-1]]
    first = np.flatnonzero(fresh)
    counts = np.diff(np.append(first, len(values)))
    nth = np.empty(len(values), np.int32)
    nth[order] = np.where(np.repeat(counts, counts) > 1, np.arange(len(values)) - np.repeat(first, counts), -1)
    return nth


def of_shared_anchors(contexts: DataFrame) -> DataFrame:
    """The contexts whose anchor another context has too; only these can repeat anything.

    Contexts of one slice of text that share an anchor (``nth`` from 0 on) stay in any case, so only
    one of them meets those of other slices and a very common anchor is dealt over many tasks. Each
    task streams through its sorted rows and holds one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None
        before = None
        for batch in batches:
            if not len(batch):
                continue
            if last is not None:
                batch = pa.concat_batches([last, batch])
            anchor = batch.column("anchor").to_numpy()
            same = anchor[1:] == anchor[:-1]
            shared = np.append(same, False)
            shared[1:] |= same
            shared[0] |= before is not None and before == anchor[0]
            shared |= batch.column("nth").to_numpy() >= 0
            # The last row waits for the one that follows it.
            yield batch.slice(0, len(batch) - 1).filter(pa.array(shared[:-1])).drop_columns(["nth"])
            last, before = batch.slice(len(batch) - 1), anchor[-2] if len(batch) > 1 else before
        if last is not None and (before == last.column("anchor")[0].as_py() or last.column("nth")[0].as_py() >= 0):
            yield last.drop_columns(["nth"])

    dealt = contexts.repartition(F.col("anchor"), F.greatest("nth", F.lit(0))).sortWithinPartitions("anchor")
    return dealt.mapInArrow(tidy(run), CONTEXT_FIELDS)


def with_text(chosen: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The bytes of chosen contexts, cut from their documents."""
    by_doc = chosen.groupBy("__id", "__hash").agg(
        F.collect_list(F.struct("start", "windows", "offset", "anchor", "digest")).alias("c")
    )
    rows = docs.select("__id", "__hash", F.col("text").cast("binary").alias("b")).join(by_doc, ["__id", "__hash"])
    return rows.select("b", F.explode("c").alias("c")).select(
        "c.anchor",
        "c.digest",
        "c.offset",
        F.expr(f"substring(b, c.start + 1, c.windows + {length - 1})").alias("body"),
    )


def compared(open_contexts: DataFrame, length: int) -> DataFrame:
    """(anchor, digest, spans): repeated windows of contexts whose anchor has others, as intervals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int, int, bytes]] = []

        def indexed() -> pa.RecordBatch:
            held = repeated_by_index([body for _, _, body in waiting], length)
            out = as_marks([(a, d) for a, d, _ in waiting], held)
            waiting.clear()
            return out

        size = 0
        for anchor, digest, offset, body in runs_of_key(batches, 1):
            order = np.unique(digest, return_index=True)[1]  # contexts once each
            bodies = [body[i] for i in order.tolist()]
            names = [(int(anchor[i]), int(digest[i])) for i in order.tolist()]
            own = sum(map(len, bodies))
            if len(bodies) < 2:
                continue
            if own > INDEX_BYTES:
                yield as_marks(names, repeated_by_offset(bodies, offset[order].astype(np.int64), length))
                continue
            if size + own > INDEX_BYTES:
                yield indexed()
                size = 0
            waiting += [(a, d, b) for (a, d), b in zip(names, bodies, strict=True)]
            size += own
        if waiting:
            yield indexed()

    dealt = open_contexts.select("anchor", "digest", "offset", "body").repartition("anchor")
    return dealt.sortWithinPartitions("anchor").mapInArrow(tidy(run), "anchor long, digest long, spans binary")


def as_marks(names: list[tuple[int, int]], held: list[np.ndarray]) -> pa.RecordBatch:
    some = [i for i, h in enumerate(held) if h.any()]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([names[i][0] for i in some], pa.int64()),
            pa.array([names[i][1] for i in some], pa.int64()),
            pa.array([intervals(held[i]).tobytes() for i in some], pa.binary()),
        ],
        names=["anchor", "digest", "spans"],
    )


def counted(open_contexts: DataFrame, length: int) -> DataFrame:
    """The same by a shuffle of window digests, for anchors with more text than one task should hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, digest, body in zip(*(batch.column(c).to_pylist() for c in ("anchor", "digest", "body")), strict=True):
                n = len(body) - length + 1
                raw = b"".join(xxhash.xxh3_128_digest(body[i : i + length]) for i in range(n))
                both = np.frombuffer(raw, "<i8").reshape(n, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.full(n, anchor)), pa.array(np.full(n, digest))]
                    + [pa.array(np.arange(n, dtype=np.int32))],
                    names=["w0", "w1", "anchor", "digest", "at"],
                )

    windows = open_contexts.mapInArrow(tidy(run), "w0 long, w1 long, anchor long, digest long, at int")
    often = windows.groupBy("w0", "w1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    found = windows.join(often, ["w0", "w1"]).groupBy("anchor", "digest").agg(F.sort_array(F.collect_set("at")).alias("at"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for at in batch.column("at").to_pylist():
                held = np.zeros(at[-1] + 1, bool)
                held[at] = True
                spans.append(intervals(held).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("anchor"), batch.column("digest"), pa.array(spans, pa.binary())],
                names=["anchor", "digest", "spans"],
            )

    return found.mapInArrow(tidy(pack), "anchor long, digest long, spans binary")


def repeated_starts(docs: DataFrame, length: int, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(__id, __hash, spans): for every document the starts of windows that occur elsewhere too.

    ``spans`` lists (first place, intervals) of the document's contexts.
    """
    rows = stored(of_shared_anchors(all_contexts(docs, length)), "contexts")
    place = F.min(F.struct("__id", "__hash", "start", "windows", "offset")).alias("p")
    kinds = stored(rows.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("n"), place), "kinds")
    size = F.sum(F.col("p.windows") + F.lit(length - 1)).alias("bytes")
    anchors = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), size).where("kinds > 1")
    several = kinds.join(anchors.select("anchor", "bytes"), "anchor").select("anchor", "digest", "bytes", "p.*")
    body = stored(with_text(several.where(F.col("bytes") <= group_bytes).drop("bytes"), docs, length), "bodies")
    marks = compared(body, length)
    large = several.where(F.col("bytes") > group_bytes).drop("bytes")
    if not large.isEmpty():
        marks = marks.union(counted(with_text(large, docs, length), length))
    # A context that occurs twice as a whole repeats all its windows.
    decided = (
        kinds.select("anchor", "digest", "n")
        .join(marks, ["anchor", "digest"], "left")
        .where((F.col("n") > 1) | F.col("spans").isNotNull())
        .select("anchor", "digest", F.when(F.col("n") == 1, F.col("spans")).alias("spans"))
    )
    found = rows.join(decided, ["anchor", "digest"])
    return found.groupBy("__id", "__hash").agg(F.collect_set(F.struct("start", "windows", "spans")).alias("spans"))


def word_codes(rows: DataFrame) -> DataFrame:
    """Keys and texts as CODE bytes a word, for words between ASCII white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for part in slices(batch, "text", SMALL):
                words, offsets = words_of(texts_of(part.column("text")))
                coded = words.dictionary_encode()
                kinds = np.array([digest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], "<u8")
                data = kinds[coded.indices.to_numpy(zero_copy_only=False)].view(np.uint8).reshape(-1, 8)[:, :CODE]
                body = binaries(data, offsets * CODE)
                yield pa.RecordBatch.from_arrays(
                    [part.column("__id"), part.column("__hash"), body], names=["__id", "__hash", "text"]
                )

    return rows.select("__id", "__hash", "text").mapInArrow(tidy(run), "__id long, __hash long, text binary")


def passages_mask(text: bytes, spans: list[dict] | None, words: int) -> np.ndarray:
    """Bytes of the passages of ``words`` words that ``spans`` of the text's word codes name."""
    change = np.zeros(len(text) + 1, np.int64)
    places = np.array([m.span() for m in WORD.finditer(text)], np.int64).reshape(-1, 2)
    for span in spans or ():
        inner = [[0, span["windows"]]] if span["spans"] is None else np.frombuffer(span["spans"], "<i4").reshape(-1, 2)
        for a, b in inner:
            first, last = -(-(span["start"] + int(a)) // CODE), (span["start"] + int(b) - 1) // CODE
            if first <= last:
                change[places[first, 0]] += 1
                change[places[last + words - 1, 1]] -= 1
    return np.cumsum(change[:-1]) > 0


def removed_mask(size: int, spans: list[dict] | None, length: int) -> np.ndarray:
    change = np.zeros(size + 1, np.int64)
    for span in spans or ():
        inner = [[0, span["windows"]]] if span["spans"] is None else np.frombuffer(span["spans"], "<i4").reshape(-1, 2)
        for a, b in inner:
            change[span["start"] + a] += 1
            change[span["start"] + b + length - 1] -= 1
    return np.cumsum(change[:-1]) > 0


def whole_characters(gone: np.ndarray, text: bytes) -> np.ndarray:
    """The mask without characters of which some byte is left."""
    if not len(gone):
        return gone
    starts = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return np.repeat(np.logical_and.reduceat(gone, starts), np.diff(np.append(starts, len(gone))))


def remove_repeats(
    docs: DataFrame,
    length: int = 400,
    characters: bool = False,
    group_bytes: int = GROUP_BYTES,
    words: int | None = None,
) -> DataFrame:
    """``docs`` with ``kept`` (bytes that are left), ``spans`` (removed intervals), n_bytes, n_removed, n_spans.

    Every byte inside a string of ``length`` bytes that starts at another place too, in this
    or another document, is removed; strings are judged on the input. With ``words`` so is every
    passage of that many words that is at another place too, whatever its bytes and the white space
    between its words. With ``characters`` a character stays whole while one of its bytes stays,
    so ``kept`` is UTF-8. Texts shorter than both, empty or null lose nothing (null counts as
    empty). Every row stays; rows that are equal repeat each other. Columns of ``docs`` with the new names are replaced.
    """
    if length < 1:
        raise ValueError("a string has at least one byte")
    columns = [c for c in docs.columns if c not in ("kept", "spans", "n_bytes", "n_removed", "n_spans")]
    rows = keyed(docs.select(*columns))
    found = repeated_starts(rows, length, group_bytes).withColumnRenamed("spans", "__spans")
    if words is None:
        rows = rows.withColumn("__passages", F.lit(None).cast(found.schema["__spans"].dataType))
    else:
        passages = repeated_starts(word_codes(rows), words * CODE, group_bytes).withColumnRenamed("spans", "__passages")
        rows = rows.join(passages, ["__id", "__hash"], "left")
    rows = rows.join(found, ["__id", "__hash"], "left").select(*columns, "__spans", "__passages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 * SMALL):
                texts = part.column("text").cast(pa.binary()).fill_null(b"").to_pylist()
                kept, cut, removed = [], [], []
                found = (part.column(c).to_pylist() for c in ("__spans", "__passages"))
                for text, spans, passages in zip(texts, *found, strict=True):
                    gone = removed_mask(len(text), spans, length) if spans else np.zeros(len(text), bool)
                    if passages:
                        gone |= passages_mask(text, passages, words)
                    if characters and spans:
                        gone = whole_characters(gone, text)
                    cut.append(intervals(gone).tolist())
                    removed.append(int(gone.sum()))
                    kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes() if removed[-1] else text)
                new = [
                    pa.array(kept, pa.binary()),
                    pa.array(cut, pa.list_(pa.int32())),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array([len(c) // 2 for c in cut], pa.int64()),
                ]
                old = [part.column(c) for c in columns]
                names = [*columns, "kept", "spans", "n_bytes", "n_removed", "n_spans"]
                yield pa.RecordBatch.from_arrays(old + new, names=names)

    fields = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes if name not in ("__spans", "__passages"))
    return rows.mapInArrow(
        tidy(run), f"{fields}, kept binary, spans array<int>, n_bytes long, n_removed long, n_spans long"
    )
