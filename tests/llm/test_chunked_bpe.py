"""Chunked byte-level BPE against the tiktoken library."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry_points
from dockspan.llm.rank_bpe import RankBpe, Stitcher, decode_ids, encode_texts, find_pre_tokens, model

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(row):
    return [int.from_bytes(row.ids[i : i + 4], "little") for i in range(0, len(row.ids), 4)]


def odd_texts():
    rng = random.Random(3)
    letters = list(" \n\t'   abcsretlmdv") + ["é", "日", "\x1c", "\x85", "\xa0", "12", "'re", "'ll", "  ", "!?", "\x00", "\U0001f600"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 150))) for _ in range(300)]


@pytest.mark.parametrize("chunk, overlap", [(1 << 15, 256), (64, 16), (5, 0), (1, 3)])
def test_ids_and_round_trip(spark, docs, rows, library, chunk, overlap):
    coded = decode_ids(encode_texts(docs, PATH, PATTERN, chunk=chunk, overlap=overlap), PATH, PATTERN)
    got = {r.doc_id: r for r in coded.collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        want = library.encode_ordinary(text or "")
        assert ids_of(got[i]) == want and got[i].n_tokens == len(want)
        assert got[i].decimals == " ".join(map(str, want))
        assert bytes(got[i].decoded) == (text or "").encode()


def test_odd_texts(library):
    bpe = RankBpe(PATH, PATTERN)
    for text in odd_texts():
        ids, edges = bpe.ids([bpe.pattern.findall(text)])
        assert ids.tolist() == library.encode_ordinary(text) and edges.tolist() == [0, len(ids)]


def test_words_merge_side_by_side_as_alone(library):
    bpe = RankBpe(PATH, PATTERN)
    rng = random.Random(8)
    words = ["".join(rng.choice(" aeinorst'é日.\x00") for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    found = list(bpe.merge_all(words + words[:5] + ["a", " the"]))
    assert found == [bpe.merge(w.encode()) for w in words + words[:5] + ["a", " the"]]
    for split in ([w] for w in words[:300]):
        assert next(bpe.merge_all(split)) == bpe.merge(split[0].encode())
    assert list(bpe.merge_all([])) == []


def test_long_words(library):
    bpe = RankBpe(PATH, PATTERN)
    rng = random.Random(9)
    for word in ["z" * 3000, "ab" * 500, "日本" * 400, "".join(rng.choice("abcde") for _ in range(5000))]:
        assert bpe.merge(word.encode()) == library.encode_ordinary(word)


def test_stitching_goes_on_over_chunks_without_a_boundary(spark):
    split = model(PATH, PATTERN).pattern
    text = "ab " + "x" * 100 + " cd  ef"
    chunks = [(s, text[s : s + 12], s + 10 >= len(text)) for s in range(0, len(text), 10)]
    frame = spark.createDataFrame([("k", s // 10, s, t, last) for s, t, last in chunks], "key string, no long, start long, text string, last boolean")
    found = sorted(find_pre_tokens(frame, PATH, PATTERN).collect(), key=lambda r: r.no)
    stitcher, units = Stitcher(split), []
    for r in found:
        piece, lengths = stitcher.piece(r.start, r.text, np.array(r.lengths, np.int32), r.last)
        at = 0
        for n in lengths.tolist():
            units.append(piece[at : at + n])
            at += n
        assert at == len(piece)
    assert units == split.findall(text)


@pytest.mark.parametrize("chunk", [1 << 15, 4])
def test_odd_tables(bare, empty, library, chunk):
    got = sorted((r.doc_id is not None, r.doc_id or 0, ids_of(r)) for r in encode_texts(bare, PATH, PATTERN, chunk).collect())
    want = sorted((r.doc_id is not None, r.doc_id or 0, library.encode_ordinary(r.text or "")) for r in bare.collect())
    assert got == want
    assert decode_ids(encode_texts(empty, PATH, PATTERN, chunk), PATH, PATTERN).collect() == []


def test_query_on_the_whole_table(spark, library):
    got = {r.doc_id: r for r in entry_points.queries()["op11_chunked_bpe"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text or "")
        own = got.pop(r.doc_id)
        assert own.n_tokens == len(ids)
        assert own.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert own.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert not got
