"""Every operator against a plain version on mixed texts, with nulls, ties, repeats and empty tables."""

import collections
import hashlib
import math
import os
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dockspan.llm import bpe, mixing, packing, quality, repeats, sharding, simhash, token_counts, top_k
from dockspan.llm.components import connected
from dockspan.llm.line_templates import drop_recurring_lines
from dockspan.llm.queries import packed_pieces

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


# Token counts


def test_token_counts(docs, rows):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    found = by_id(token_counts.count_tokens(docs, WORD_BPE, limit=100))
    assert len(found) == len(rows)
    for i, text in rows:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        assert (found[i].n_bytes, found[i].n_tokens) == (len((text or "").encode()), n)
        assert found[i].over_limit == (n > 100)


def test_token_counts_of_odd_rows(bare, empty):
    assert token_counts.count_tokens(bare, WORD_BPE).count() == 6
    assert token_counts.count_tokens(empty, WORD_BPE).count() == 0


def test_balanced_calls():
    words = ["a" * n for n in (5, 5, 5, 50, 1, 1)]
    assert [len(x) for x in token_counts.balanced(words, 10)] == [2, 1, 1, 2]
    assert sum(token_counts.balanced(words, 10), []) == words


def test_unit_table_is_bounded():
    asked = []
    table = token_counts.UnitTable(lambda new: (asked.append(u) or [len(u)] * len(u) for u in new), limit=4)
    for units in (["a", "bb"], ["a", "ccc", "dddd"], ["e", "a"], ["f", "a"], ["a", "bb", "a"]):
        starts, lengths = table.look_up(units)
        assert [table.flat[s : s + n].tolist() for s, n in zip(starts, lengths)] == [[len(u)] * len(u) for u in units]
    assert asked.count("a") == 1 and len(table.places) <= 6


# Byte-level BPE


def test_ids_and_texts_match_the_library(docs, rows):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    found = by_id(bpe.decode_ids(bpe.encode_texts(docs, BYTE_BPE), BYTE_BPE))
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(found[i].ids, "<u4").tolist() == ids
        assert found[i].decoded == tokenizer.decode(ids, skip_special_tokens=False)


def test_words_match_the_library_on_random_letters():
    rng = np.random.default_rng(3)
    tokenizer, model = Tokenizer.from_file(BYTE_BPE), bpe.model(BYTE_BPE)[0]
    for alphabet in ("ab", "etaoin", "aeé日"):
        for _ in range(300):
            text = "".join(rng.choice(list(alphabet), rng.integers(1, 40)))
            assert model.unit(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_bytes_that_are_no_text(spark):
    frame = spark.createDataFrame([(1, bytearray(np.array([158, 187], "<u4").tobytes())), (2, None)], "doc_id long, ids binary")
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    found = by_id(bpe.decode_ids(frame, BYTE_BPE))
    assert found[1].decoded == tokenizer.decode([158, 187], skip_special_tokens=False) and found[2].decoded == ""


# Long repeats


@pytest.mark.parametrize("length", [400, 40])
def test_repeats(docs, rows, length):
    bodies, masks = brute.repeats([t for _, t in rows], length)
    found = by_id(repeats.remove_repeats(docs, length))
    for (i, _), body, mask in zip(rows, bodies, masks, strict=True):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(int)))
        assert found[i].spans == edges.tolist()
        assert bytes(found[i].kept) == np.frombuffer(body, np.uint8)[~mask].tobytes()
        assert (found[i].n_bytes, found[i].n_removed, found[i].n_spans) == (len(body), mask.sum(), len(edges) // 2)
        assert found[i].lang == "en" and found[i].shard == 7


def test_repeats_of_large_groups(docs, rows, monkeypatch):
    _, masks = brute.repeats([t for _, t in rows], 40)
    found = by_id(repeats.remove_repeats(docs, 40, group_bytes=500))
    assert [found[i].n_removed for i, _ in rows] == [m.sum() for m in masks]


def test_repeats_offset_by_offset():
    rng = np.random.default_rng(1)
    base = bytes(rng.integers(97, 123, 90).astype(np.uint8))
    contexts = [base, base[:50] + b"#" + base[51:], b"!!" + base[2:], base[5:] + b"?"]
    offsets = np.array([30, 30, 30, 25])
    by_index = repeats.repeated_by_index(contexts, 20)
    by_offset = repeats.repeated_by_offset(contexts, offsets, 20)
    assert [x.tolist() for x in by_index] == [x.tolist() for x in by_offset]


def test_longest_matches_on_random_texts():
    rng = np.random.default_rng(2)
    for alphabet, size in ((2, 60), (3, 200), (1, 30)):
        contexts = [bytes(rng.integers(97, 97 + alphabet, rng.integers(1, size)).astype(np.uint8)) for _ in range(6)]
        index = repeats.RunLengthIndex(contexts)
        text = index.text.tolist()
        best = index.longest_matches()
        for i in range(len(text)):
            lengths = [0]
            for j in range(len(text)):
                n = 0
                while i != j and max(i, j) + n < len(text) and text[i + n] == text[j + n]:
                    n += 1
                lengths.append(n)
            assert best[i] == max(lengths)


def test_repeats_keep_characters_whole(spark):
    common = "é日本x" * 120
    frame = spark.createDataFrame([(1, "à" + common), (2, "á" + common + "z")], "doc_id long, text string")
    found = by_id(repeats.remove_repeats(frame, 400, characters=True))
    assert bytes(found[1].kept).decode() == "à" and bytes(found[2].kept).decode() == "áz"


def test_repeats_of_odd_rows(bare, empty):
    found = repeats.remove_repeats(bare, 5).collect()
    assert len(found) == 6 and sorted(r.n_removed for r in found) == [0, 0, 0, 0, 14, 14]
    assert repeats.remove_repeats(empty).count() == 0


# Near-duplicates


def test_near_duplicates(docs, rows):
    label = brute.near_components(rows)
    found = by_id(simhash.near_duplicates(docs))
    for i, text in rows:
        assert found[i]["print"] & (2**64 - 1) == brute.simhash(text)
        assert found[i].component_id == label[i]
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(label.values())


def test_near_duplicates_of_odd_rows(bare, empty):
    found = simhash.near_duplicates(bare).collect()
    assert len(found) == 6
    assert collections.Counter((r.doc_id, r.component_id) for r in found) == {(None, 6): 1, (None, None): 1, (5, 5): 2, (6, 6): 2}
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("tree", [4096, 7])
def test_links_connect_all_close_prints(spark, monkeypatch, tree):
    monkeypatch.setattr(simhash, "TREE", tree)
    rng = np.random.default_rng(4)
    values = {int(x) for x in rng.integers(0, 2**63, 40)}
    for x in list(values)[:8]:
        for _ in range(12):
            values.add(x ^ sum(1 << int(b) for b in set(rng.integers(0, 63, rng.integers(1, 7)).tolist())))
    values = sorted(values)
    frame = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "print long, node long")
    roots = {r.node: r.root for r in connected(simhash.near_links(frame)).collect()}
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(values):
            for j, y in enumerate(values):
                if (x ^ y).bit_count() <= 4 and label[j] < label[i]:
                    label[i], changed = label[j], True
    assert [roots.get(i, i) for i in range(len(values))] == label


def test_bk_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(6)
    prints = np.unique(rng.integers(0, 1 << 12, 300).astype(np.uint64))
    tree = simhash.BkTree(prints)
    found = {(int(q), int(n)) for a, b in tree.within(prints, 2) for q, n in zip(a, b)}
    near = np.bitwise_count(prints[:, None] ^ prints) <= 2
    assert found == {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(near)))}


def test_connected_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 90), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in connected(links).collect()}
    assert roots == {i: 0 for i in range(1, 61)} | {100: 90}


# Recurring lines


@pytest.mark.parametrize("min_docs", [3, 10])
def test_recurring_lines(docs, rows, min_docs):
    expected = brute.recurring(rows, 3, min_docs, 0.6)
    found = by_id(drop_recurring_lines(docs, 3, min_docs, 0.6))
    for i, text in rows:
        n_lines, n_dropped, left = expected[i]
        assert (found[i].n_lines, found[i].n_dropped) == (n_lines, n_dropped)
        assert (found[i].text or "") == left and (found[i].text is None) == (text is None)
    assert any(r.n_dropped for r in found.values())


def test_recurring_lines_of_odd_rows(bare, empty):
    found = drop_recurring_lines(bare, min_docs=1).collect()
    assert len(found) == 6 and {r.slot for r in found} == {None, "x", "y"}
    assert drop_recurring_lines(empty).count() == 0


# Quality rules


def test_word_statistics(docs, rows, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = by_id(quality.judge_quality(docs, labels))
    for i, text in rows:
        r = found[i]
        own = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert own == brute.word_statistics(text)
        assert r.kept == (not r.base_failed) and r.shard == 7


def test_rules_follow_the_labels(spark):
    good = " ".join(f"word{i % 97}x{i}" for i in range(80))
    data = [(i, good + (" #$%&" * 20 if i % 4 == 0 else f" number {i}")) for i in range(80)]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame(
        [(i, int(i % 4 != 0), 0) for i in range(60)] + [(None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int"
    )
    found = by_id(quality.judge_quality(frame, labels))
    assert all(found[i].kept == (i % 4 != 0) for i in range(80))


def test_rule_list_is_ordered_and_pruned():
    rng = np.random.default_rng(0)
    rows = {"a": rng.random(3000), "b": rng.random(3000)}
    bad = ((rows["a"] > 0.8) & (rows["b"] > 0.5)) | (rows["b"] < 0.1)
    rules = quality.fit_rules(rows, bad)
    caught = np.zeros(3000, bool)
    for rule in rules:
        caught |= quality.covers(rule, rows, 3000)
    assert (caught & bad).sum() / bad.sum() > 0.9 and (caught & ~bad).sum() / caught.sum() < 0.1
    assert quality.fit_rules(rows, np.zeros(3000, bool)) == []


def test_quality_of_odd_rows(bare, empty, spark):
    labels = spark.createDataFrame([(5, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.judge_quality(bare, labels).where("NOT kept").count() == 6
    assert quality.judge_quality(empty, labels).count() == 0


def test_quality_plan_has_no_python(docs, spark):
    labels = spark.createDataFrame([(20, 0, 0)], "doc_id long, quality int, toxic int")
    for frame in (quality.judge_quality(docs, labels), drop_recurring_lines(docs)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "InArrow"))


# Top-k search


def test_top_k(spark):
    rng = np.random.default_rng(8)
    data = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(150)]
    data[7] = (7, data[6][1])
    data += [(20, None), (40, [1.0] * 7 + [float("nan")]), (60, [1.0, None] + [0.0] * 6), (None, [1.0] * 8), (80, [1.0] * 3)]
    data = [r for n, r in enumerate(data) if r[0] not in (20, 40, 60) or n >= 150]
    data += [(200, [0.5] * 3), (201, []), (220, [])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in data]
    own = [x for x in as_float if x[0] != 80] + [x for x in as_float if x[0] == 80][:1]
    found = sorted(map(tuple, top_k.top_k_search(frame.where("vec_id IS NULL OR vec_id <> 80"), F.col("vec_id") % 20 == 0, k=5).collect()))
    own = [x for x in as_float if x[0] != 80]
    assert found == sorted(brute.top_k(own, lambda q: q % 20 == 0, 5))
    assert top_k.top_k_search(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_beyond_floats():
    big = np.array([[2.0**40, 3.0], [2.0**40, 1.0], [-(2.0**40), 5.0]])
    rows, ids, scores = top_k.best_of_block(np.array([1]), big[:1], np.array([1, 2, 3]), big, 2)
    assert ids.tolist() == [2, 3] and scores.tolist() == [2**63 - 1, -(2**63)]


def test_bounds_hold():
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(50, 12)), rng.normal(size=(60, 12))
    for segments in (1, 3, 12, 20):
        bound = top_k.statistics(a, segments) @ top_k.statistics(b, segments).T
        assert (bound >= a @ b.T - 1e-9).all()


# Shards


def test_shards(docs, rows):
    found = by_id(sharding.shard_documents(docs, 24))
    slots = collections.defaultdict(list)
    for i, text in rows:
        r = found[i]
        body = (text or "").encode()
        assert (r["size"], r.text_crc32) == (len(body) + 8, zlib.crc32(body))
        assert r.grown_shard == r.shard or r.grown_shard == 24
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_odd_rows(bare, empty):
    found = sharding.shard_documents(bare, 3).collect()
    assert len(found) == 6 and len({r.shard for r in found if r.doc_id is None}) == 1
    assert sharding.shard_documents(empty).count() == 0


def test_weights_move_documents_only_into_the_heavier_shard(spark):
    keys = spark.range(6000).withColumnRenamed("id", "doc_id")
    moved = sharding.assign_shards(keys, 24)
    moved = sharding.assign_shards(moved, 24, {5: 3.0}, out="heavier")
    counts = collections.Counter(r.shard for r in moved.collect())
    assert max(counts.values()) < 1.4 * 250 and min(counts.values()) > 0.65 * 250
    changed = moved.where("shard <> heavier").collect()
    assert changed and all(r.heavier == 5 for r in changed)
    assert 2 < moved.where("heavier = 5").count() / counts[5] < 4


# Packing


def check_pieces(found, rows, capacity=2048):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted(pieces[i], key=lambda r: r.start)
        assert np.frombuffer(b"".join(bytes(r.ids) for r in own), "<u4").tolist() == ids
        at = 0
        for r in own:
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length == len(r.ids) // 4
            at += r.length
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += capacity - at
    return padding, len(sequences)


def test_packing(docs, rows):
    check_pieces(packed_pieces(docs).collect(), rows)


def test_packing_of_odd_rows(bare, empty):
    found = packed_pieces(bare).collect()
    assert len({(r.sequence_id, r.offset) for r in found}) == len(found) == 6
    assert packed_pieces(empty).count() == 0


def test_differencing_is_nearly_even():
    rng = np.random.default_rng(1)
    sizes = [n for _ in range(300) for n in packing.cut(int(rng.lognormal(6.5, 1)) + 1, 2048, 32) if n < 2048]
    windows = packing.share_out(sizes, 2048)
    sums = np.bincount(windows, weights=sizes)
    assert sums.max() <= 2048 and sums.sum() == sum(sizes)
    assert 1 - sums.sum() / (2048 * len(sums)) < 0.03
    assert packing.differencing([5, 5, 5], 2).tolist().count(0) in (1, 2)


def test_window_count_rises():
    assert len(set(packing.share_out([3, 3, 3], 5).tolist())) == 3


# Language model


def test_base_scores(docs, rows):
    found = by_id(mixing.score_documents(docs))
    for (i, _), own in zip(rows, brute.base_scores(rows), strict=True):
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == own[:3]
        assert math.isclose(r.base_score, own[3], rel_tol=1e-9) and r.held_out == brute.held_out(i)
        assert r.score < 0


def test_scores_of_odd_rows(bare, empty):
    found = mixing.score_documents(bare).collect()
    assert len(found) == 6 and all(r.n_tokens >= 1 for r in found)
    assert mixing.score_documents(empty).count() == 0


def test_tokens_have_a_proper_distribution(spark):
    words = ["the", "then", "of", "é"]
    tables = [(np.zeros(1 << b, np.float32), np.zeros(1 << b, np.float32)) for b in mixing.TABLES]
    events = mixing.Events(words)
    for (ones, total), slots in zip(tables, events.slots):
        np.add.at(total, slots.ravel(), 1)
        np.add.at(ones, slots.ravel(), events.bits.ravel())
    mixer = mixing.Mixer(tables)
    mixer.learn(words, np.array([5.0, 2.0, 7.0, 1.0]))
    odds, sets = mixer.inputs(events, 0.0)
    p = mixer.predict(odds, sets, events.partial)[1]
    assert ((p > 0) & (p < 1)).all()
    likely, other = mixer.log10(["the", "qzx"])
    assert likely > other


def test_held_out_texts_compress(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = mixing.score_documents(frame).where("held_out AND n_tokens > 100").collect()
    assert found and np.mean([r.bits_per_byte for r in found]) < 3.2


# Registered queries


def test_queries_return_their_columns(spark):
    import __spark_entry__ as entry_points

    found = entry_points.queries()
    sf = "/root/testdata/sf0.001"
    numbers = [int(name[2:].split("_")[0]) for name in found if name.startswith("op") and name[2].isdigit()]
    assert sorted(numbers) == list(range(1, 14))
    count = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op3_prefix_bpe", "op9_hash_tree_shards", "op2_token_counts"):
        assert found[name](spark, sf).count() == count
    pieces = found["op10_differencing_pack"](spark, sf)
    assert pieces.select("doc_id").distinct().count() == count
    row = found["op3_prefix_bpe"](spark, sf).where("doc_id = 0").first()
    text = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id = 0").first().text
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_pipeline_stages(spark, docs, tmp_path, rows):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    sf = os.fspath(tmp_path)
    labels.write.parquet(f"{sf}/labels.parquet")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    current = dict(rows)

    frame = stages["quality rules"](spark, frame, sf)
    current = {i: t for i, t in current.items() if not brute.word_statistics(t)[-1]}
    assert {r.doc_id: r.text for r in frame.collect()} == current

    frame = stages["line dedup"](spark, frame, sf)
    current = {i: x[2] for i, x in brute.recurring(list(current.items()), 3, 10, 0.6).items()}
    assert {r.doc_id: r.text for r in frame.collect()} == current

    frame = stages["near duplicates"](spark, frame, sf)
    current = {i: current[i] for i in set(brute.near_components(list(current.items())).values())}
    assert {r.doc_id: r.text for r in frame.collect()} == current

    frame = stages["long repeats"](spark, frame, sf)
    bodies, masks = brute.repeats(list(current.values()), 400)
    for i, body, mask in zip(list(current), bodies, masks):
        left, at = [], 0
        for c in body.decode():
            size = len(c.encode())
            left += [] if mask[at : at + size].all() else [c]
            at += size
        current[i] = "".join(left)
    got = frame.collect()
    assert frame.columns == plain.columns
    assert {r.doc_id: r.text for r in got} == current and all(r.n_chars == len(r.text) for r in got)
    check_pieces(stages["packing"](spark, frame, sf).collect(), list(current.items()))
    assert corpus_pipeline.run(spark, sf).count() == stages["packing"](spark, frame, sf).count()
