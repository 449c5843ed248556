"""Token counts of whole texts.

Texts are cut at ASCII white space, where this tokenizer never joins anything:
its normaliser composes no character with a space and its splitter drops white
space. Equal words of a batch are encoded once, in calls of about equal bytes,
and only lengths leave the Arrow function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from dockspan.llm.batches import UnitTable, slices, sums_by_row, texts_of, words_of

CALL_BYTES = 1 << 18
_TABLES: dict[str, UnitTable] = {}


def balanced(words: list[str], limit: int = CALL_BYTES) -> Iterator[list[str]]:
    """Runs of words of about ``limit`` characters each; a longer word stands alone."""
    start, held = 0, 0
    for i, word in enumerate(words):
        if i > start and held + len(word) > limit:
            yield words[start:i]
            start, held = i, 0
        held += len(word)
    if len(words) > start:
        yield words[start:]


def length_table(path: str) -> UnitTable:
    """Lengths by word for one tokenizer file, kept by the worker process."""
    if path not in _TABLES:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        def lengths(words: list[str]) -> Iterator[list[int]]:
            for call in balanced(words):
                for encoded in tokenizer.encode_batch_fast(call, add_special_tokens=False):
                    yield [len(encoded)]

        _TABLES[path] = UnitTable(lengths)
    return _TABLES[path]


def lengths_of(texts: pa.Array, path: str) -> np.ndarray:
    table = length_table(path)
    words, offsets = words_of(texts)
    coded = words.dictionary_encode()
    starts, _ = table.look_up(coded.dictionary.to_pylist())
    by_word = table.flat[starts].astype(np.int64)
    return sums_by_row(by_word[coded.indices.to_numpy()], offsets)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Bytes and tokens of every text, and whether the tokens exceed ``limit``.

    ``path`` names the tokenizer file, which every worker must have. Null and
    empty texts have 0 tokens; rows repeat as they come; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = texts_of(part.column("text"))
                tokens = lengths_of(texts, path)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pc.binary_length(texts).cast(pa.int64()),
                        pa.array(tokens, pa.int64()),
                        pa.array(tokens > limit, pa.bool_()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
