import random

from pyspark.sql import functions as F

from dockspan.operators.durable import shared_folder
from dockspan.operators.ordering import ranked, running, running_by_position, with_neighbours


def rows(spark, n=500, seed=1):
    rng = random.Random(seed)
    # One group holds most of the rows.
    data = [("hot" if rng.random() < 0.8 else rng.choice("abc"), rng.randint(0, 40), i) for i in range(n)]
    return spark.createDataFrame(data, "g string, v int, id int").repartition(4)


def test_sliced_scan_equals_window(spark):
    df = rows(spark)
    order = [F.col("v").desc(), F.col("id")]
    sums = {"total": F.col("v"), "odd": F.col("v") % 2}
    plain = running(df, ["g"], order, sums, "pos")
    sliced = running(df, ["g"], order, sums, "pos", max_group_rows=0)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, sliced.collect()))


def test_rank_over_whole_table(spark):
    df = rows(spark)
    got = {r.id: r["rank"] for r in ranked(df, [], [F.col("v").desc(), F.col("id")]).collect()}
    want = sorted(df.collect(), key=lambda r: (-r.v, r.id))
    assert [got[r.id] for r in want] == list(range(1, len(want) + 1))


def test_null_group_is_a_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, v int")
    for limit in (10, 0):
        got = ranked(df, ["g"], [F.col("v")], "p", max_group_rows=limit)
        assert sorted((r.v, r.p) for r in got.collect()) == [(1, 1), (2, 2), (3, 1)]


def test_neighbours_across_blocks(spark):
    placed = ranked(rows(spark), ["g"], [F.col("id")], "pos")

    def look(window):
        return {"back": F.lag("id", 2).over(window), "ahead": F.lead("id", 3).over(window)}

    small = with_neighbours(placed, ["g"], "pos", 3, look, block_rows=7)
    whole = with_neighbours(placed, ["g"], "pos", 3, look)
    assert small.count() == placed.count()
    key = lambda r: r.id
    assert sorted(small.collect(), key=key) == sorted(whole.collect(), key=key)


def test_running_by_position(spark):
    placed = ranked(rows(spark), ["g"], [F.col("id")], "pos")
    got = running_by_position(placed, ["g"], "pos", F.col("v"), "total", block_rows=5)
    want = running(placed, ["g"], [F.col("pos")], {"total": F.col("v")})
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_named_checkpoint_folder_is_kept(spark):
    first = shared_folder(spark)
    assert first and shared_folder(spark) == first
