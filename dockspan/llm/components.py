"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dockspan.operators.durable import durable


def _both_ways(links: DataFrame) -> DataFrame:
    return links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _with_least(links: DataFrame) -> DataFrame:
    """Every link with the least of a and a's partners; reduced before the shuffle."""
    least = links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return links.join(least, "a")


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) but the roots; a root is the least node of its component.

    Null ends and links of a node to itself say nothing and are left out. Each
    round is stored, so a lost executor costs no earlier round.
    """
    edges = durable(links.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    while True:
        large = _with_least(_both_ways(edges)).where((F.col("b") > F.col("a")) & (F.col("b") != F.col("m")))
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = _with_least(down)
        to_least = small.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = small.select("a", F.col("m").alias("b")).where(F.col("a") != F.col("b"))
        following = durable(to_least.union(own).distinct())
        if _same(edges, following):
            return following.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = following


def _same(one: DataFrame, other: DataFrame) -> bool:
    """Equal link tables, by count and two sums of hashes."""

    def digest(links: DataFrame):
        h = F.xxhash64("a", "b")
        return links.agg(
            F.count(F.lit(1)), F.sum(F.shiftright(h, 16)), F.sum(F.shiftright(F.xxhash64("b", "a"), 16))
        ).first()

    return digest(one) == digest(other)
