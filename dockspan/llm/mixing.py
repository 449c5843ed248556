"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A token is coded byte by byte and bit by bit. Predictors see the last one to four bytes of
the token, and all of it so far; each looks its context up by hash in a table of counts that
the whole training text has filled. Their log-odds are added with weights from a set that
the counts of two contexts choose, and the sum is refined by an adaptive map from (bits so
far of the byte, sum) to what followed. Weights and map are learned online in one pass over
the training vocabulary, each token predicted from the counts without itself, then updated.

That code of a token doesn't depend on the tokens before it, so equal tokens are counted and scored
once: blocks of documents carry their own dictionaries, a shuffle on the word adds up counts
and brings scores back, and no vocabulary is held whole anywhere.

Contexts of the one and the two tokens before it predict the whole token, by how often it followed
them in training documents. Their predictions and that by bits are mixed for every token, with
weights from a set that the counts of both contexts choose. A block learns the weights from its
training documents; a token of these is predicted from the counts without itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from dockspan.llm.batches import texts_of, tidy, words_of
from dockspan.llm.repeats import powers
from dockspan.llm.tables import stored
from dockspan.llm.word_contexts import (
    WORD_BYTES,
    Contexts,
    context_counts,
    counts_by_token,
    from_planes,
    planes,
    starts_of,
    tokens_of,
    word_hashes,
)

BLOCK_BYTES = 24 << 20
# A word is followed by a space; the end of a text is this byte, which no word holds.
END = "\n"
# Slots of the tables, as powers of two: one to four bytes, then the whole token so far.
TABLES = (16, 18, 20, 21, 21)
CHUNK = 16
WORD_BATCH = 16_384
# The tables whose counts choose the weight set.
GATES = (2, 4)
SETS = 6 * 6
MAP_STEPS = 33
STRETCH = 8.0
RATE = 0.1
# Degrees of the counts of one previous token and of two, and tokens that the first weights stand for.
CONTEXT_DEGREES = (8, 6)
FIRST_SHARES = (12.0, 4.0, 4.0)
ROUNDS = 3
# The least probability by bits that weights are learned with.
LEAST = 1e-30
TOKENS_AT_ONCE = 1 << 18
# Dictionary entries that are packed at a time.
ENTRIES_AT_ONCE = 1 << 19


def end_of(word: str) -> str:
    return word if word == END else word + " "


class Events:
    """Bits of a batch of tokens with their slots in every table."""

    def __init__(self, words: list[str]):
        coded = [end_of(w).encode() for w in words]
        lengths = np.array([len(c) for c in coded], np.int64)
        data = np.frombuffer(b"".join(coded), np.uint8)
        first = np.repeat(np.cumsum(lengths) - lengths, lengths)
        place = np.arange(len(data)) - first
        self.token = np.repeat(np.arange(len(words)), lengths)
        self.tokens = len(words)
        byte = data.astype(np.uint64)
        before = [np.where(place >= back, np.roll(byte, back) + np.uint64(1), np.uint64(0)) for back in (1, 2, 3, 4)]
        up, down = powers(len(data) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((byte + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
        whole = (sums[:-1] - sums[first]) * down[first] + place.astype(np.uint64)
        contexts, own = [], np.zeros(len(data), np.uint64)
        for back in before:
            own = own * np.uint64(257) + back
            contexts.append(own)
        contexts.append(whole)
        shifts = np.arange(8, dtype=np.uint64)
        self.partial = (np.uint64(1) << shifts) | (byte[:, None] >> (np.uint64(8) - shifts))
        self.bits = (byte[:, None] >> (np.uint64(7) - shifts)) & np.uint64(1)
        self.slots = []
        bitwise = self.partial.astype(np.uint32) * np.uint32(0x9E3779B1)
        for n, (context, bits) in enumerate(zip(contexts, TABLES, strict=True)):
            mixed = context * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD6E8FEB86659FD93 + 2 * n)
            mixed ^= mixed >> np.uint64(31)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            slots = bitwise ^ (mixed >> np.uint64(32)).astype(np.uint32)[:, None]
            slots *= np.uint32(0x85EBCA6B)
            slots >>= np.uint32(32 - bits)
            self.slots.append(slots.astype(np.int64))

    def by_token(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.token, weights=values.sum(axis=1), minlength=self.tokens)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def log_odds(ones: np.ndarray, total: np.ndarray) -> np.ndarray:
    # In double precision up to the ratio, or the small parts are lost beside counts of many millions.
    odds = (ones.astype(float) + 0.2) / (total.astype(float) - ones + 0.2)
    return np.clip(np.log(odds.astype(np.float32)), -STRETCH, STRETCH)


def steps_of(total: np.ndarray) -> np.ndarray:
    """Counts as one of six degrees of confidence."""
    return np.minimum(np.log2(total + 1).astype(np.int8), 10) // 2


class Mixer:
    """Gated weights and the refining map over given tables (ones, all) per predictor."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]):
        self.tables = tables
        self.ready: dict[int, tuple] = {}
        k = len(tables)
        self.weights = np.full((SETS, k), 1.0 / k + 0.1)
        self.slope = np.full((SETS, k), 1e-2)
        centres = np.linspace(-STRETCH, STRETCH, MAP_STEPS)
        self.map_all = np.full((256, MAP_STEPS), 4.0)
        self.map_ones = np.tile(4.0 * squash(centres), (256, 1))
        self.seen = 0.0

    def inputs(self, events: Events, less: float) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of every predictor and the weight set; ``less`` is taken off the counts."""
        odds, confident = [], []
        for k, (slots, (ones, total)) in enumerate(zip(events.slots, self.tables, strict=True)):
            if less:
                n = np.maximum(total[slots] - less, 0)
                odds.append(log_odds(np.clip(ones[slots] - less * events.bits, 0, n), n))
                step = steps_of(n) if k in GATES else None
            else:
                if k not in self.ready:
                    self.ready[k] = (log_odds(ones, total), steps_of(total) if k in GATES else None)
                odds.append(self.ready[k][0][slots])
                step = self.ready[k][1][slots] if k in GATES else None
            if step is not None:
                confident.append(step.astype(np.int64))
        return np.stack(odds), confident[1] * 6 + confident[0]

    def predict(self, odds: np.ndarray, sets: np.ndarray, partial: np.ndarray):
        mixed = sum(own * weights[sets] for own, weights in zip(odds, self.weights.T.astype(np.float32), strict=True))
        mixed = np.clip(mixed.astype(float), -STRETCH, STRETCH)
        at = (mixed + STRETCH) * ((MAP_STEPS - 1) / (2 * STRETCH))
        low = np.minimum(at.astype(np.int64), MAP_STEPS - 2)
        part = at - low
        low += partial.astype(np.int64) * MAP_STEPS
        table = (self.map_ones / self.map_all).ravel()
        refined = table[low]
        refined += (table[low + 1] - refined) * part
        plain = squash(mixed)
        return plain, np.clip((plain + refined) / 2, 1e-6, 1 - 1e-6), low + (part >= 0.5)

    def learn(self, words: list[str], counts: np.ndarray) -> None:
        """Predict the tokens from the counts without one of each, then follow the errors."""
        events = Events(words)
        odds, sets = self.inputs(events, 1.0)
        plain, _, nearest = self.predict(odds, sets, events.partial)
        bits = events.bits.astype(float)
        share = np.repeat(counts[events.token], 8).reshape(-1, 8)
        error = (bits - plain) * share
        weight = np.bincount(sets.ravel(), weights=share.ravel(), minlength=SETS) + 1e-9
        for k in range(len(odds)):
            slope = np.bincount(sets.ravel(), weights=(error * odds[k]).ravel(), minlength=SETS) / weight
            self.slope[:, k] += slope * slope
            self.weights[:, k] += RATE * slope / np.sqrt(self.slope[:, k]) * (weight > 1e-6)
        place = nearest.ravel()
        self.map_all += np.bincount(place, weights=share.ravel(), minlength=256 * MAP_STEPS).reshape(256, -1)
        self.map_ones += np.bincount(place, weights=(share * bits).ravel(), minlength=256 * MAP_STEPS).reshape(256, -1)
        self.seen += float(share.sum())

    def log10(self, words: list[str]) -> np.ndarray:
        """log10 of every token's probability."""
        events = Events(words)
        odds, sets = self.inputs(events, 0.0)
        _, p, _ = self.predict(odds, sets, events.partial)
        return events.by_token(np.log10(np.where(events.bits == 1, p, 1 - p)))


def byte_runs(words: list[str], limit: int = 1 << 17) -> Iterator[slice]:
    """Slices of the list with about ``limit`` bytes each."""
    start, held = 0, 0
    for i, word in enumerate(words):
        held += len(word) + 1
        if held >= limit or i + 1 - start >= WORD_BATCH:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(words):
        yield slice(start, len(words))


def in_training(doc_id: int | None) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7 != 2


def block_of(docs: pa.Table, number: int) -> pa.RecordBatch:
    """One row: documents, their tokens as codes, and the dictionary with counts in training documents."""
    texts = texts_of(docs.column("text"))
    words, offsets = words_of(pc.ascii_lower(texts))
    coded = words.dictionary_encode()
    size = len(coded.dictionary)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # Every text ends with the token after the words of the dictionary.
    ends = offsets[1:] + np.arange(len(texts))
    tokens = np.full(len(codes) + len(texts), size, np.int64)
    inner = np.ones(len(tokens), bool)
    inner[ends] = False
    tokens[inner] = codes
    lengths = np.diff(offsets) + 1
    names = docs.column("doc_id").to_pylist()
    training = np.array([in_training(d) for d in names], bool)
    counts = np.bincount(tokens, weights=np.repeat(training, lengths), minlength=size + 1).astype(np.int64)
    # Frequent words get small codes, which are stored in fewer bytes.
    order = np.argsort(-np.bincount(tokens, minlength=size + 1), kind="stable")
    code = np.empty(size + 1, np.int64)
    code[order] = np.arange(size + 1)
    tokens = code[tokens]
    dictionary = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([END])]).take(pa.array(order))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number], pa.int64()),
            pa.array([names], pa.list_(pa.int64())),
            pa.array([(~training).tolist()], pa.list_(pa.bool_())),
            pa.array([pc.binary_length(texts).to_pylist()], pa.list_(pa.int64())),
            pa.array([lengths.tolist()], pa.list_(pa.int64())),
            pa.array([planes(tokens, 4)], pa.binary()),
            pa.ListArray.from_arrays(pa.array([0, size + 1], pa.int32()), dictionary),
            pa.array([counts[order].tolist()], pa.list_(pa.int64())),
        ],
        names=["block", "doc_id", "held_out", "n_bytes", "n_tokens", "codes", "words", "counts"],
    )


BLOCK_FIELDS = (
    "block long, doc_id array<long>, held_out array<boolean>, n_bytes array<long>, n_tokens array<long>, "
    "codes binary, words array<string>, counts array<long>"
)


def blocks_of(docs: DataFrame) -> DataFrame:
    """Documents as blocks of bounded text, one row each; blocks follow the table's own partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        held, size = [], 0
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                held.append(part)
                size += int(pc.sum(pc.binary_length(part.column("text"))).as_py() or 0)
                if size >= BLOCK_BYTES:
                    yield block_of(pa.Table.from_batches(held), number)
                    number, held, size = number + 1, [], 0
        if sum(len(x) for x in held):
            yield block_of(pa.Table.from_batches(held), number)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), BLOCK_FIELDS)


def fill_tables(vocabulary: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts of ones and of all bits per slot, from every training token.

    Tasks add up their own tables and send chunks of them; the sum has a fixed size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((2, 1 << bits)) for bits in TABLES]
        for batch in batches:
            words, counts = batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(float)
            for own in byte_runs(words, 1 << 19):
                events = Events(words[own])
                weight = np.repeat(counts[own][events.token], 8)
                ones = weight * events.bits.ravel()
                for table, slots in zip(sums, events.slots, strict=True):
                    table[0] += np.bincount(slots.ravel(), weights=ones, minlength=table.shape[1])
                    table[1] += np.bincount(slots.ravel(), weights=weight, minlength=table.shape[1])
        for k, table in enumerate(sums):
            for at in range(0, table.shape[1], 1 << CHUNK):
                body = table[:, at : at + (1 << CHUNK)]
                if body.any():
                    yield chunk_row(k, at, body)

    def add(key, table):
        bodies = table.column("body").to_pylist()
        total = sum(np.frombuffer(zlib.decompress(b), "<f8").reshape(2, -1) for b in bodies)
        return pa.Table.from_batches([chunk_row(key[0].as_py(), key[1].as_py(), total)])

    fields = "k int, at int, body binary"
    chunks = vocabulary.mapInArrow(tidy(run), fields).groupBy("k", "at").applyInArrow(add, fields)
    out = [np.zeros((2, 1 << bits), np.float32) for bits in TABLES]
    for row in chunks.toLocalIterator():
        body = np.frombuffer(zlib.decompress(row["body"]), "<f8").reshape(2, -1)
        out[row["k"]][:, row["at"] : row["at"] + body.shape[1]] = body
    return [(t[0], t[1]) for t in out]


def chunk_row(k: int, at: int, body: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k], pa.int32()), pa.array([at], pa.int32()), pa.array([zlib.compress(body.astype("<f8").tobytes(), 1)])],
        names=["k", "at", "body"],
    )


def learn_mixer(vocabulary: DataFrame, shared) -> dict[str, np.ndarray]:
    """Weights and map learned online by every task over its words; weights averaged, maps added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = Mixer(shared.value)
        for batch in batches:
            words, counts = batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(float)
            for own in byte_runs(words, 1 << 14):
                mixer.learn(words[own], counts[own])
        if mixer.seen:
            body = np.concatenate([[mixer.seen], mixer.weights.ravel(), mixer.map_all.ravel(), mixer.map_ones.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([body.tobytes()], pa.binary())], names=["body"])

    fresh = Mixer(shared.value)
    weights, map_all, map_ones, seen = np.zeros_like(fresh.weights), fresh.map_all, fresh.map_ones, 0.0
    prior_all, prior_ones = map_all.copy(), map_ones.copy()
    # One row of a fixed size a task; an iterator would run the tasks one by one.
    for row in vocabulary.mapInArrow(tidy(run), "body binary").collect():
        body = np.frombuffer(row["body"])
        n, w, m = body[0], weights.size, map_all.size
        weights += n * body[1 : 1 + w].reshape(weights.shape)
        map_all += body[1 + w : 1 + w + m].reshape(map_all.shape) - prior_all
        map_ones += body[1 + w + m :].reshape(map_ones.shape) - prior_ones
        seen += n
    return {"weights": weights / seen if seen else fresh.weights, "map_all": map_all, "map_ones": map_ones}


def score_words(vocabulary: DataFrame, shared, learned: dict[str, np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = Mixer(shared.value)
        for name, value in learned.items():
            setattr(mixer, name, value)
        for batch in batches:
            words = batch.column("word").to_pylist()
            parts = [mixer.log10(words[own]) for own in byte_runs(words)]
            scores = np.concatenate(parts) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=["word", "c", "lp"])

    return vocabulary.select("word", "c").mapInArrow(tidy(run), "word string, c long, lp double")


# Degree of a count, of one previous token and of two; only a count of 0 has degree 0.
_ONE = np.minimum((np.log2(np.arange(1, 1 << 13)).astype(np.int64) + 1) // 2, CONTEXT_DEGREES[0] - 1).astype(np.uint8)
_TWO = np.minimum(np.log2(np.arange(1, 1 << 5)).astype(np.int64), CONTEXT_DEGREES[1] - 1).astype(np.uint8)


class TokenMixer:
    """Weights of three predictions of a token: by its bits, after one token and after two."""

    def __init__(self):
        self.shares = np.tile(FIRST_SHARES, (CONTEXT_DEGREES[0] * CONTEXT_DEGREES[1], 1))

    @staticmethod
    def inputs(pair: np.ndarray, one: np.ndarray, context: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, ...]:
        """Weight sets and the predictions by contexts, given how often the token followed one and two tokens
        (``pair``, ``context``) and how often these came (``one``, ``two``).
        """
        sets = _ONE[np.minimum(one, len(_ONE) - 1)] * np.uint8(CONTEXT_DEGREES[1]) + _TWO[np.minimum(two, len(_TWO) - 1)]
        return sets, (pair / np.maximum(one, 1)).astype(np.float32), (context / np.maximum(two, 1)).astype(np.float32)

    def weights(self) -> np.ndarray:
        """By prediction and set; the weights of contexts that never came go to the others."""
        found = self.shares.T.reshape(3, *CONTEXT_DEGREES).copy()
        found[1, 0], found[2, :, 0] = 0, 0
        return (found / found.sum(axis=0)).reshape(3, -1)

    def mix(self, by_bits: np.ndarray, sets: np.ndarray, *given: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Probabilities, and the part of each prediction in them."""
        parts = [weights[sets] * own for weights, own in zip(self.weights(), (by_bits, *given), strict=True)]
        p = parts[0] + parts[1] + parts[2]
        return p, [part / p for part in parts]

    def log10(self, by_bits: np.ndarray, sets: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """log10 of the probabilities; ``by_bits`` has that of the prediction by bits, which can be too small for a number."""
        weights = self.weights()
        found = np.log10(weights[0])[sets] + by_bits
        hit = np.flatnonzero((one > 0) | (two > 0))
        own = sets[hit]
        found[hit] = np.log10(10.0 ** found[hit] + weights[1][own] * one[hit] + weights[2][own] * two[hit])
        return found

    def learn(self, by_bits: np.ndarray, parts: list[tuple]) -> None:
        """Shares by what each prediction had in the probabilities of the tokens in training, again and again.

        ``parts`` has codes of tokens, whether they are in training, and their inputs; ``by_bits`` is by code.
        """
        size = len(self.shares)
        held, hits = np.tile(FIRST_SHARES, (size, 1)), []
        for tokens, training, (sets, one, two) in parts:
            held[:, 0] += np.bincount(sets[training], minlength=size)
            # The prediction by bits has the whole share of the other tokens.
            hit = np.flatnonzero(training & ((one > 0) | (two > 0)))
            hits.append((by_bits[tokens[hit]], sets[hit], one[hit], two[hit]))
        for _ in range(ROUNDS):
            shares = held.copy()
            for inputs in hits:
                part = self.mix(*inputs)[1]
                for k in (1, 2):
                    moved = np.bincount(inputs[1], weights=part[k], minlength=size)
                    shares[:, k] += moved
                    shares[:, 0] -= moved
            self.shares = shares


def token_parts(known, tokens, starts, training, pairs, contexts) -> Iterator[tuple[np.ndarray, np.ndarray, tuple]]:
    """Runs of a block's tokens, whether they are in training, and the inputs of :class:`TokenMixer`.

    A training token is taken off its own counts.
    """
    size = len(tokens)
    first = np.zeros(size, bool)
    first[starts] = True
    # Every text starts once and ends once.
    texts = known[tokens[-1]]
    for at in range(0, size, TOKENS_AT_ONCE):
        own = slice(at, min(at + TOKENS_AT_ONCE, size))
        back = np.maximum(np.arange(own.start, own.stop) - 1, 0)
        less = training[own].astype(np.int64)
        one = np.where(first[own], texts, known[tokens[back]]) - less
        two = np.where(first[own], 0, pairs[back] - less)
        context = np.where(first[own], 0, contexts[own] - less)
        yield tokens[own], training[own], TokenMixer.inputs(pairs[own] - less, one, context, two)


def packed(found: DataFrame) -> DataFrame:
    """Codes, scores, hashes and counts of a block's words as few rows: part (-1), block, x, y, z, w."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def rows() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks().sort_by([("own", "ascending"), ("code", "ascending")])
            block, code = table.column("own").to_numpy(), table.column("code").to_numpy().astype(np.int64)
            count, score = table.column("c").to_numpy(), table.column("lp").to_numpy().astype("<f4")
            hashes = word_hashes(table.column("word").combine_chunks())
            edges = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
            x, y, z, w = [], [], [], []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                x.append(planes(np.diff(code[a:b], prepend=0), 4))
                w.append(planes(count[a:b], 6))
                y.append(score[a:b].tobytes())
                z.append(planes(hashes[a:b], WORD_BYTES))
            own = block[edges[:-1]]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(own), -1)), pa.array(own)] + [pa.array(v, pa.binary()) for v in (x, y, z, w)],
                names=["part", "block", "x", "y", "z", "w"],
            )

        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= ENTRIES_AT_ONCE:
                yield rows()
                held, size = [], 0
        if size:
            yield rows()

    columns = ("own", "code", "word", "c", "lp")
    return found.select(*columns).mapInArrow(tidy(run), "part long, block long, x binary, y binary, z binary, w binary")


def unpacked(rows: list[dict], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, scores and hashes by code from a block's rows of :func:`packed`."""
    counts, scores, hashes = np.zeros(size, np.int64), np.zeros(size), np.zeros(size, np.uint64)
    for row in rows:
        at = np.cumsum(from_planes(row["x"], 4)).astype(np.int64)
        counts[at], scores[at] = from_planes(row["w"], 6).astype(np.int64), np.frombuffer(row["y"], "<f4")
        hashes[at] = from_planes(row["z"], WORD_BYTES)
    return counts, scores, hashes


RESULT = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
    "score double, bits_per_byte double"
)


def score_documents(docs: DataFrame) -> DataFrame:
    """Base and model scores (log10) of every whole text, learned from the documents in training.

    A document is held out if the CRC-32 of its id as text leaves 2 modulo 7; a null id is the
    empty text and in training. Texts are lower-cased in A-Z and scored as words and one end;
    a null text is only its end. Without training documents the model has its priors and base
    scores are those of no counts. ``bits_per_byte`` counts the end as a byte. Repeated rows
    are scored, and learned from, as often as they come; other columns are left out.
    """
    spark = docs.sparkSession
    blocks = stored(blocks_of(docs), "blocks")
    pairs = F.arrays_zip("words", "counts")
    words = blocks.select(F.col("block").alias("own"), F.posexplode(pairs).alias("code", "w")).select(
        "own", "code", F.col("w.words").alias("word"), F.col("w.counts").alias("c")
    )
    vocabulary = stored(words.groupBy("word").agg(F.sum("c").alias("c")), "vocabulary")
    known = vocabulary.where("c > 0")
    totals = known.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    few = known.coalesce(max(2, spark.sparkContext.defaultParallelism))
    shared = spark.sparkContext.broadcast(fill_tables(few))
    scored = score_words(vocabulary, shared, learn_mixer(few, shared))
    found = packed(words.select("own", "code", "word").join(scored, "word"))
    arrived = found.unionByName(context_counts(blocks), allowMissingColumns=True)
    train_tokens, denominator = int(totals["n"]), float(totals["n"] + totals["v"] + 1)

    def gather(key, block, arrived):
        row = {name: block.column(name)[0] for name in ("doc_id", "held_out", "n_bytes", "n_tokens", "codes")}
        tokens = tokens_of(row["codes"].as_py())
        lengths = row["n_tokens"].values.to_numpy()
        starts = starts_of(lengths)
        rows = arrived.to_pylist()
        counts, scores, hashes = unpacked([r for r in rows if r["part"] < 0], int(tokens.max()) + 1)
        given = [(r["part"], r["x"], r["y"]) for r in rows if r["part"] >= 0]
        pairs, contexts = counts_by_token(Contexts(hashes, tokens, starts), given)
        base = np.add.reduceat(np.log10((counts + 1) / denominator)[tokens], starts)
        training = np.repeat(~row["held_out"].values.to_numpy(zero_copy_only=False), lengths)
        parts = list(token_parts(counts, tokens, starts, training, pairs, contexts))
        mixer = TokenMixer()
        del pairs, contexts
        mixer.learn(np.maximum(10.0**scores, LEAST).astype(np.float32), parts)
        each = np.concatenate([mixer.log10(scores[own], *inputs) for own, _, inputs in parts])
        score = np.add.reduceat(each, starts)
        n_bytes = row["n_bytes"].values.to_numpy()
        return pa.table(
            {
                "doc_id": row["doc_id"].values,
                "held_out": row["held_out"].values,
                "n_tokens": pa.array(lengths, pa.int64()),
                "n_known": pa.array(np.add.reduceat((counts > 0)[tokens].astype(np.int64), starts)),
                "train_tokens": pa.array(np.full(len(lengths), train_tokens)),
                "base_score": pa.array(base),
                "score": pa.array(score),
                "bits_per_byte": pa.array(-score / np.log10(2) / (n_bytes + 1)),
            }
        )

    lists = blocks.select("block", "doc_id", "held_out", "n_bytes", "n_tokens", "codes")
    return lists.groupBy("block").cogroup(arrived.groupBy("block")).applyInArrow(gather, RESULT)
