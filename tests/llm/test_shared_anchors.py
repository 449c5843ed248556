"""Contexts that cannot repeat anything are dropped before they are stored."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from dockspan.llm import repeats
from dockspan.llm.repeats import all_contexts, of_shared_anchors, places_among_equals, remove_repeats
from dockspan.llm.tables import keyed


def test_only_shared_anchors_stay(docs):
    every = all_contexts(keyed(docs), 60)
    often = {r.anchor for r in every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").collect()}
    found = of_shared_anchors(every)
    assert 0 < found.count() < every.count()
    wanted = collections.Counter(tuple(r) for r in every.drop("nth").collect() if r.anchor in often)
    assert collections.Counter(tuple(r) for r in found.collect()) == wanted


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_runs_go_on_over_batches(spark, size):
    anchors = [1, 2, 2, 2, 3, 4, 4, 5, 6, 6, 6, 6, 6, 7]
    rows = [(i, i, 0, 1, 0, a, i, -1) for i, a in enumerate(anchors)]
    fields = f"{repeats.CONTEXT_FIELDS}, nth int"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        found = of_shared_anchors(spark.createDataFrame(rows, fields).coalesce(1)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.anchor for r in found) == [a for a in anchors if anchors.count(a) > 1]


def test_equals_of_one_slice_stay_and_spread(spark):
    assert places_among_equals(np.array([5, 7, 5, 9, 5, 7])).tolist() == [0, 0, 1, -1, 2, 1]
    rows = [(i, i, 0, 1, 0, 8, i, i) for i in range(300)] + [(300, 300, 0, 1, 0, 9, 1, -1)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = of_shared_anchors(spark.createDataFrame(rows, f"{repeats.CONTEXT_FIELDS}, nth int"))
        parts = found.withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r["__id"] for r in parts) == list(range(300))
    assert len({r["part"] for r in parts}) > 1


def test_contexts_are_stored_without_lone_anchors(docs, monkeypatch):
    kept = {}

    def stored(df, label, plain=repeats.stored):
        kept[label] = plain(df, label)
        return kept[label]

    monkeypatch.setattr(repeats, "stored", stored)
    remove_repeats(docs, 60).count()
    assert not [r for r in kept["contexts"].groupBy("anchor").count().collect() if r["count"] == 1]
