"""Ranked lexical search against a plain version."""

import collections
import math
import re

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from dockspan.llm.mask_search import Best, Block, Question, ranked_search

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, items, k):
    counted = [(d, collections.Counter(TERMS.findall(brute.lower(t)))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    big_n, big_l = len(counted), sum(n for _, _, n in counted)
    df = collections.Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        asked = TERMS.findall(brute.lower(text))
        for d, c, n in counted:
            m = 75 + 25 * n * big_n // big_l
            score = sum(
                math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t in asked
                if t in c
            )
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return out


def result(frame):
    rows = [(r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect()]
    return sorted(rows, key=lambda r: [(x is None, x or 0) for x in r])


def expected(docs, items, k):
    return sorted(plain(docs, items, k), key=lambda r: [(x is None, x or 0) for x in r])


@pytest.fixture(scope="module")
def items(spark, rows):
    some = [(i, t) for i, t in rows if t][3:30]
    wide = " ".join(f"W{i * 7919 % 613}" for i in range(300))
    data = [*some, (900, None), (901, ""), (902, "...--"), (903, wide), (None, "the of the OF re"), (904, "nowhere found"), (905, "The-the_THE")]
    return data, spark.createDataFrame([(i, t, 1, "x") for i, t in data], "item_id long, text string, score int, rank string")


@pytest.mark.parametrize("k, pass_terms, block_docs", [(20, 200_000, 1 << 14), (3, 400, 5)])
def test_ranks(docs, rows, items, k, pass_terms, block_docs):
    data, frame = items
    found = ranked_search(docs, frame, k=k, pass_terms=pass_terms, block_docs=block_docs)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert result(found) == expected(rows, data, k)


def test_ties_repeats_and_nulls(spark, docs, rows, items):
    data, frame = items
    twice = rows + rows + [(None, "the of re"), (None, "the of re"), (None, None)]
    table = docs.select("doc_id", "text")
    more = spark.createDataFrame(twice[2 * len(rows) :], "doc_id long, text string")
    assert result(ranked_search(table.union(table).union(more), frame, k=7, block_docs=16)) == expected(twice, data, 7)


def test_empty_tables(docs, items, empty):
    assert ranked_search(empty, items[1]).collect() == []
    assert ranked_search(docs, items[1].where(F.lit(False))).collect() == []
    assert ranked_search(docs, items[1].where("item_id = 901")).collect() == []


def test_masks_of_low_bounds_are_not_evaluated():
    rng = np.random.default_rng(4)
    lengths = rng.integers(50, 90, 4000)
    held = [np.flatnonzero(rng.random(40) < 0.2) for _ in lengths]
    held[17] = held[1234] = np.arange(40)
    edges = np.concatenate([[0], np.cumsum([len(h) for h in held])])
    terms = np.concatenate(held)
    block = Block(lengths, edges, terms, np.ones(len(terms), np.int64), 4000, int(lengths.sum()))
    best = Best([Question(1, np.arange(40), rng.integers(500, 3000, 40))], 2)
    best.add(block, np.arange(4000), np.zeros(4000, bool))
    assert sorted(best.ids[0].tolist()) == [17, 1234]
    assert best.evaluated < 0.1 * best.matched
