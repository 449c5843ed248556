"""Line dedup with a log-template tree.

A line goes down a tree of fixed depth: its number of words, then its leading words,
where words with a digit count as a variable field. In the leaf a word is constant at its
place if at least ``min_docs`` lines of the leaf have it there, else a variable field; the
constants and fields are the line's template. A line that has too few constants for one gets
a second chance in which its words with a digit count like others, as they are: dates, numbered
lines and whatever recurs word for word. Templates found in ``min_docs`` or more documents
recur. Leaves of fewer documents hold no recurring template, so only the lines
of larger leaves are parsed word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dockspan.llm.tables import keyed
from dockspan.operators.durable import durable

SPACE = "[\\x20\\x09-\\x0D]+"
FIELD = "<*>"


def masked(word: Column) -> Column:
    """The word, or the mark of a variable field where it holds a digit."""
    return F.when(word.rlike("[0-9]"), F.lit(FIELD)).otherwise(word)


def words_of_line(line: Column) -> Column:
    return F.filter(F.split(line, SPACE), lambda w: w != "")


def lines_of(docs: DataFrame, depth: int) -> DataFrame:
    """Lines that hold a word: key, place, text and leaf."""
    lines = keyed(docs).select("__id", "__hash", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    filled = lines.where(F.col("line").rlike("[^\\x20\\x09-\\x0D]")).withColumn("words", words_of_line(F.col("line")))
    leading = F.transform(F.slice("words", 1, depth), masked)
    return filled.select("__id", "__hash", "at", "line", F.xxhash64(F.size("words"), leading).alias("leaf"))


def in_documents(rows: DataFrame, key: str, least: int) -> DataFrame:
    """Values of ``key`` found in at least ``least`` documents; counted in two steps, so no value is gathered."""
    once = rows.select(key, "__id").distinct()
    return once.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).select(key)


def templates(docs: DataFrame, depth: int, min_docs: int, share: float) -> DataFrame:
    """Key, place and template hash of every line in a leaf of ``min_docs`` documents.

    A line with less than ``share`` constant words has no template, unless it reaches the share with
    words that hold a digit and recur at their place. So a line that comes word for word in ``min_docs``
    documents always has one.
    """
    lines = lines_of(docs, depth)
    busy = in_documents(lines, "leaf", min_docs)
    # Lines travel as text, which packs best; only those of busy leaves are split again.
    words = words_of_line(F.col("line"))
    parsed = lines.join(busy, "leaf").select("__id", "__hash", "at", "leaf", F.posexplode(words).alias("place", "word"))
    # A word's own hash stands for it from here on, odd if the word holds a digit.
    digit = F.col("word").rlike("[0-9]")
    own = F.shiftleft(F.xxhash64("word"), 1).bitwiseOR(digit.cast("long"))
    parsed = durable(parsed.select("__id", "__hash", "at", "leaf", "place", own.alias("word")))
    common = (
        parsed.groupBy("leaf", "place", "word")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_docs)
        .select("leaf", "place", "word", F.lit(True).alias("constant"))
    )
    # A sum of hashes of (place, word) stands for the list of constants; it needs no gathering.
    token = F.xxhash64("place", "word").cast("decimal(20,0)")
    odd = F.col("word").bitwiseAND(F.lit(1)) == 1
    plain, numbered = F.col("constant") & ~odd, F.col("constant") & odd
    lines = (
        parsed.join(common, ["leaf", "place", "word"], "left")
        .groupBy("__id", "__hash", "at", "leaf")
        .agg(
            F.sum(F.when(plain, token)).alias("total"),
            F.count(F.when(plain, True)).alias("constants"),
            F.sum(F.when(numbered, token)).alias("more"),
            F.count(F.when(numbered, True)).alias("numbers"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    enough = F.col("n") * F.lit(share)
    return lines.where(F.col("constants") + F.col("numbers") >= enough).select(
        "__id",
        "__hash",
        "at",
        F.when(F.col("constants") >= enough, F.xxhash64("leaf", "total", "constants"))
        .otherwise(F.xxhash64("leaf", "total", "constants", "more", "numbers"))
        .alias("template"),
    )


def recurring_lines(docs: DataFrame, depth: int = 3, min_docs: int = 10, share: float = 0.6) -> DataFrame:
    """Key and place of every line to drop: lines of recurring templates but for the first.

    The first line of a template, by doc_id and place, stays as its example.
    """
    found = durable(templates(docs, depth, min_docs, share))
    often = in_documents(found, "template", min_docs)
    first = (
        found.join(often, "template")
        .groupBy("template")
        .agg(F.min(F.struct("__id", "at")).alias("first"))
        .select("template", F.col("first.__id").alias("first_id"), F.col("first.at").alias("first_at"))
    )
    other = (F.col("__id") != F.col("first_id")) | (F.col("at") != F.col("first_at"))
    return found.join(first, "template").where(other).select("__id", "__hash", "at").distinct()


def drop_recurring_lines(docs: DataFrame, depth: int = 3, min_docs: int = 10, share: float = 0.6) -> DataFrame:
    """``docs`` with recurring lines cut from ``text``; adds n_lines and n_dropped (lines with a word).

    Every row stays, with what is left of its text; a text without dropped lines, null
    included, is as it was. Rows that are equal lose the same lines. ``doc_id`` should be a
    key: rows that share it count as one document. Columns n_lines and n_dropped of ``docs``
    are replaced.
    """
    drops = (
        recurring_lines(docs, depth, min_docs, share)
        .groupBy("__id", "__hash")
        .agg(F.sort_array(F.collect_list("at")).alias("__drop"))
    )
    rows = keyed(docs).join(drops, ["__id", "__hash"], "left")
    lines, drop = F.split("text", "\n", -1), F.col("__drop")

    def until(at: Column, i: Column) -> Column:
        gap = at - F.when(i == 0, F.lit(-1)).otherwise(F.get(drop, i - 1)) - 1
        return F.concat(F.array_repeat(F.lit(True), gap), F.array(F.lit(False)))

    rows = rows.withColumn("__keep", F.flatten(F.transform(drop, until))).withColumn("__lines", lines)
    # Lines after the last dropped one have no entry and stay.
    kept = F.filter("__lines", lambda line, i: F.coalesce(F.get(F.col("__keep"), i), F.lit(True)))
    out = F.when(drop.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    filled = F.size(F.filter("__lines", lambda line: line.rlike("[^\\x20\\x09-\\x0D]")))
    return rows.select(
        *[(out.alias("text") if c == "text" else F.col(c)) for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(filled).cast("long").alias("n_lines"),
        F.when(drop.isNull(), F.lit(0)).otherwise(F.size("__drop")).cast("long").alias("n_dropped"),
    )
