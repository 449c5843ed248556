"""Registered queries over the whole smallest tables against plain versions."""

import hashlib
import math
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def found(spark, name):
    rows = entry_points.queries()[name](spark, SF).collect()
    return {r["doc_id"]: r for r in rows}


def test_scores(spark, table):
    got = found(spark, "op1_context_mixing")
    for (i, _), own in zip(table, brute.base_scores(table), strict=True):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == own[:3] and r.held_out == brute.held_out(i)
        assert math.isclose(r.base_score, own[3], rel_tol=1e-9) and r.score < 0


def test_token_counts(spark, table):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = found(spark, "op2_token_counts")
    for i, text in table:
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(text.encode()), n, n > 2048)


def test_ids(spark, table):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = found(spark, "op3_prefix_bpe")
    pieces = {}
    for r in entry_points.queries()["op10_differencing_pack"](spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for i, text in table:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
        whole, at = np.array(ids + [1], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(whole))
            assert r.ids_crc32 == zlib.crc32(whole[at : at + r.length].tobytes())
            at += r.length
        assert at == len(whole)


def test_repeats(spark, table):
    got = found(spark, "op4_run_length_repeats")
    for (i, _), body, mask in zip(table, *brute.repeats([t for _, t in table], 400), strict=True):
        kept = np.frombuffer(body, np.uint8)[~mask].tobytes()
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(body), mask.sum(), spans)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_near_duplicates(spark, table):
    got = found(spark, "op5_bk_tree_neighbours")
    label = brute.near_components(table)
    for i, text in table:
        assert (got[i].fingerprint, got[i].component_id) == (f"{brute.simhash(text):016x}", label[i])


def test_statistics(spark, table):
    got = found(spark, "op7_decision_list")
    for i, text in table:
        r = got[i]
        own = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert own == brute.word_statistics(text) and not (r.base_failed and r.kept)
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality IS NOT NULL").collect()
    judged = [got[x.doc_id].kept for x in labels if not got[x.doc_id].base_failed and x.quality == 1]
    assert sum(judged) > 0.95 * len(judged)


def test_shards(spark, table):
    got = found(spark, "op9_hash_tree_shards")
    assert len(got) == len(table) and {r.law for r in got.values()} == {"key"}
    assert all(r.grown_shard in (r.shard, 24) for r in got.values())


@pytest.mark.parametrize("name", ["op6_line_templates", "op8_top_k_search"])
def test_sql_is_given(name):
    assert name in entry_points.oracle_sql()


def test_pipeline(spark, table):
    pieces = entry_points.queries()["pipeline"](spark, SF).collect()
    assert pieces and {r.doc_id for r in pieces} < {i for i, _ in table}
    assert all(r.length == len(r.ids) // 4 for r in pieces)
