"""Shards by a hierarchical weighted hash tree.

Regions hold racks and racks hold shards. A shard draws ``-ln(u) / weight`` from
a hash of (doc_id, shard); a rack's draw is its least shard draw and a region's
its least rack draw, which are draws for the summed weights below them. The
descent takes the least draw at each level. A changed weight or an added shard
therefore changes the draws on its own path only: documents move into a shard
that gained weight and out of one that lost it, and nowhere else.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

REGIONS, RACKS = 2, 3
# Numbering works on ranges of documents: shards * BUCKETS counts are its only shared table.
BUCKETS = 4096


def address(shard: int) -> tuple[int, int]:
    """Region and rack of a shard; a further shard leaves the others in their places."""
    return shard % REGIONS, shard // REGIONS % RACKS


def draw(key: Column, shard: int, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double")
    return -F.log((bits + 0.5) / float(1 << 53)) / F.lit(float(weight))


def descend(draws: Mapping[int, Column]) -> Column:
    """The shard whose region, rack and own draw are least; ties go to the smaller number."""
    tree: dict[int, dict[int, list[int]]] = {}
    for shard in sorted(draws):
        region, rack = address(shard)
        tree.setdefault(region, {}).setdefault(rack, []).append(shard)

    def least(rows: list[Column]) -> Column:
        return rows[0] if len(rows) == 1 else F.array_min(F.array(*rows))

    regions = []
    for racks in tree.values():
        best = [least([F.struct(draws[s].alias("d"), F.lit(s).alias("s")) for s in own]) for own in racks.values()]
        regions.append(least(best))
    return least(regions)["s"]


def assign_shards(
    docs: DataFrame, shards: int = 24, weights: Mapping[int, float] | None = None, key: str = "doc_id", out: str = "shard"
) -> DataFrame:
    """Add the shard of every row.

    The key and the weights alone decide. Null keys share one place; repeated
    keys share theirs. ``weights`` default to 1; a weight must be positive.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    weights = weights or {}
    draws = {s: draw(F.col(key), s, weights.get(s, 1.0)) for s in range(shards)}
    return docs.withColumn(out, descend(draws))


def number_slots(rows: DataFrame, group: str, order: list[str], out: str = "slot") -> DataFrame:
    """Number the rows of every group from 0 without gaps, whatever the group's size.

    Rows are dealt to hash buckets; a bucket's first number is the count of the
    buckets before it, from a table of at most groups * BUCKETS rows. Rows equal
    in ``order`` are numbered in any order.
    """
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(BUCKETS)).cast("int"))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(group, "__bucket")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(group, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    )
    within = Window.partitionBy(group, "__bucket").orderBy(*order)
    return (
        rows.join(F.broadcast(starts), [group, "__bucket"])
        .withColumn(out, F.col("__start") + F.row_number().over(within) - 1)
        .drop("__bucket", "__start")
    )


def shard_documents(docs: DataFrame, shards: int = 24, weights: Mapping[int, float] | None = None) -> DataFrame:
    """Shard, slot and the shard with one more shard for every document.

    Null texts count as empty, with size 8 and checksum 0. An empty table gives
    an empty result. Other columns of ``docs`` are left out, whatever their names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = assign_shards(rows, shards, weights)
    rows = assign_shards(rows, shards + 1, weights, out="grown_shard")
    return number_slots(rows, "shard", ["doc_id", "size", "text_crc32"])
