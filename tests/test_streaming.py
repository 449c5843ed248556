"""The kept newest rows: merges, removals and batches that are run again."""

import os
import random

import pytest

from dockspan.operators.durable import scratch_table
from dockspan.streaming.ingest import LatestRows


def batch(spark, rows):
    return spark.createDataFrame(rows, "k string, v int, n int").repartition(2)


def parquet_bytes(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder.removeprefix("file:")) for f in names if f.endswith(".parquet"))


def found(spark, kept):
    return {r.k: (r.v, r.n) for r in kept.rows(spark).collect()}


def test_newest_rows_over_many_batches(spark):
    rng = random.Random(4)
    kept, want, sizes = LatestRows(scratch_table(spark, "kept"), ["k"], every=2), {}, []
    for number in range(9):
        rows = {f"k{rng.randint(0, 300)}": (number, rng.randint(0, 9)) for _ in range(200)}
        rows[None] = (number, -1)
        want |= rows
        kept.write_batch(batch(spark, [(k, *v) for k, v in rows.items()]), number)
        assert found(spark, kept) == want
        sizes.append(parquet_bytes(kept.output))
    # Files follow the keys, not the batches.
    assert max(sizes[5:]) < 1.3 * max(sizes[3:5])


@pytest.mark.parametrize("last", [2, 3, 5])
def test_a_batch_that_is_run_again(spark, last):
    kept = LatestRows(scratch_table(spark, "again"), ["k"], every=2)
    batches = [[(f"k{i}", n, i) for i in range(n, n + 5)] for n in range(last + 1)]
    for number, rows in enumerate(batches):
        kept.write_batch(batch(spark, rows), number)
    want = found(spark, kept)
    kept.write_batch(batch(spark, batches[-1]), last)
    assert found(spark, kept) == want and want["k0"] == (0, 0) and want[f"k{last + 4}"] == (last, last + 4)


def test_a_broken_merge_leaves_the_snapshot_before_in_use(spark, monkeypatch):
    kept = LatestRows(scratch_table(spark, "broken"), ["k"], every=2)
    for number in range(3):
        kept.write_batch(batch(spark, [("a", number, 0), (f"k{number}", number, 1)]), number)
    plain = LatestRows._write

    def fail(self, rows, place):
        if place.startswith("notes"):
            raise OSError("lost")
        plain(self, rows.limit(1) if place.startswith("snapshots") else rows, place)

    monkeypatch.setattr(LatestRows, "_write", fail)
    rows = batch(spark, [("a", 3, 0), ("k3", 3, 1)])
    with pytest.raises(OSError):
        kept.write_batch(rows, 3)
    monkeypatch.undo()
    want = {"a": (3, 0), **{f"k{n}": (n, 1) for n in range(4)}}
    assert found(spark, kept) == want
    kept.write_batch(rows, 3)
    assert found(spark, kept) == want


def test_batches_without_rows(spark):
    kept = LatestRows(scratch_table(spark, "none"), ["k"], every=2)
    for number in range(4):
        kept.write_batch(batch(spark, []), number)
    assert found(spark, kept) == {}
    kept.write_batch(batch(spark, [("a", 1, 1)]), 4)
    assert found(spark, kept) == {"a": (1, 1)}
