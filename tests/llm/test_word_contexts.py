"""op1's contexts of the tokens before a token."""

import collections
import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from dockspan.llm import mixing, word_contexts


def corpus(seed=2):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(25)))) for i in range(60)]
    return [*rows, (60, None), (61, "A b  a B"), (62, "a b a b"), (None, "word1 word2")]


def after(tokens):
    """(previous token, token) of every token, and (the one before that, previous, token) of all but the first."""
    before = [None, *tokens[:-1]]
    return list(zip(before, tokens)), [None, *zip(before, before[1:], tokens[1:])]


def tokens_of(text):
    return [*brute.WORDS.findall(brute.lower(text)), "\n"]


@pytest.mark.parametrize("block", [1 << 24, 300])
def test_counts_of_every_token(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK_BYTES", block)
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    blocks = mixing.blocks_of(frame).cache()
    arrived = collections.defaultdict(list)
    for r in word_contexts.context_counts(blocks).collect():
        arrived[r.block].append((r.part, r.x, r.y))
    pairs, triples = collections.Counter(), collections.Counter()
    for d, text in rows:
        if not brute.held_out(d):
            one, two = after(tokens_of(text))
            pairs.update(one)
            triples.update(two[1:])
    seen = 0
    for r in blocks.collect():
        words, lengths = np.array(r.words), np.array(r.n_tokens)
        tokens, starts = word_contexts.tokens_of(r.codes), word_contexts.starts_of(lengths)
        contexts = word_contexts.Contexts(word_contexts.word_hashes(pa.array(r.words)), tokens, starts)
        found = word_contexts.counts_by_token(contexts, arrived[r.block])
        for start, size in zip(starts.tolist(), lengths.tolist(), strict=True):
            one, two = after([str(w) for w in words[tokens[start : start + size]]])
            assert found[0][start : start + size].tolist() == [pairs[x] for x in one]
            assert found[1][start + 1 : start + size].tolist() == [triples[x] for x in two[1:]]
            seen += 1
    assert seen == len(rows)


def test_word_order_and_copies_count(spark):
    rng = random.Random(7)
    phrases = [" ".join(f"w{rng.randrange(300)}" for _ in range(12)) for _ in range(20)]
    texts = [" ".join(rng.choices(phrases, k=8)) for _ in range(80)]
    rows = list(enumerate(texts))
    alone = [" ".join(f"v{rng.randrange(300)}" for _ in range(90)) for _ in range(9)]
    rows += [(100 + i, t) for i, t in enumerate(alone)] + [(200, alone[0]), (201, alone[0])]
    held = next(i for i in range(300, 400) if brute.held_out(i) and brute.held_out(i + 100))
    shuffled = rng.choice(texts).split()
    rows.append((held, " ".join(shuffled)))
    rows += [(500, "z" * 3000), (501, "".join(rng.choices("abcdefghijklmnop", k=3000)))]
    rng.shuffle(shuffled)
    rows.append((held + 100, " ".join(shuffled)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = {r.doc_id: r for r in mixing.score_documents(frame).collect()}
    assert found[held].base_score == pytest.approx(found[held + 100].base_score)
    assert found[held].score > 0.7 * found[held + 100].score and found[held].score > found[held].base_score
    assert all(np.isfinite(r.score) for r in found.values())
    assert found[200].bits_per_byte < 0.5 * found[101].bits_per_byte


def test_tokens_after_a_context_have_a_proper_distribution():
    rng = np.random.default_rng(3)
    mixer = mixing.TokenMixer()
    mixer.shares = rng.random(mixer.shares.shape) + 0.01
    by_bits, pair = rng.dirichlet(np.ones(8)), rng.integers(0, 9, 8)
    for context in (rng.binomial(pair, 0.5), np.zeros(8, np.int64)):
        for one in (pair, np.zeros(8, np.int64)):
            two = np.minimum(context, one)
            inputs = mixing.TokenMixer.inputs(one, np.full(8, one.sum()), two, np.full(8, two.sum()))
            p, parts = mixer.mix(by_bits, *inputs)
            assert np.allclose(mixer.log10(np.log10(by_bits), *inputs), np.log10(p), rtol=1e-4)
            assert p.sum() == pytest.approx(1) and np.allclose(sum(parts), 1)


def test_planes_hold_numbers():
    values = np.array([0, 1, 255, 256, (1 << 40) - 1], np.uint64)
    assert word_contexts.from_planes(word_contexts.planes(values, 5), 5).tolist() == values.tolist()
    assert not len(word_contexts.from_planes(word_contexts.planes(values[:0], 5), 5))
