"""Quality rules as a learned decision list.

Text statistics are plain column expressions. Sequential covering grows one conjunction
of thresholds after another for the rejected class, prunes each on rows it was not grown
on, and leaves the rows a rule covers out of the next one. The list becomes one ordered
conditional expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

WORD = "[^\\x20\\x09-\\x0D]+"
# At most this many labelled rows, those with the least hash of their id, are used for fitting.
SAMPLE = 20_000
CUTS = 24

RATES = (
    "n_words",
    "mean_word",
    "symbol_rate",
    "dup_line_rate",
    "repeat_rate",
    "distinct_rate",
    "upper_rate",
    "digit_rate",
    "mark_rate",
    "shout_rate",
)


def repeated_words(rows: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``: words in 3-word windows that the text holds twice or more.

    A window is one long: the high bits of its hash, then its place. Sorting brings equal
    windows together; neighbours with equal hash bits are compared word by word.
    """
    windows = F.greatest(F.size("words") - 2, F.lit(0)).cast("long")
    rows = rows.withColumn("__bits", F.length(F.bin(windows)))
    rows = rows.withColumn("__mask", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__bits")) - 1)
    words, mask, bits = F.col("words"), F.col("__mask"), F.col("__bits")

    def keyed(i: Column) -> Column:
        hashed = F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        return hashed.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))

    empty = F.array().cast("array<bigint>")
    places = F.when(windows > 0, F.sequence(F.lit(0), (windows - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("__keys", F.sort_array(F.transform(places, keyed)))
    keys = F.col("__keys")

    def same(k: Column) -> Column:
        x, y = F.get(keys, k), F.get(keys, k - 1)
        equal = F.call_function("shiftright", x, bits) == F.call_function("shiftright", y, bits)
        for step in range(3):
            equal = equal & (
                F.get(words, x.bitwiseAND(mask).cast("int") + step) == F.get(words, y.bitwiseAND(mask).cast("int") + step)
            )
        return equal

    later = F.when(windows > 1, F.sequence(F.lit(1), (windows - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("__hits", F.filter(later, same))

    def covered(k: Column) -> Column:
        x, y = F.get(keys, k).bitwiseAND(mask), F.get(keys, k - 1).bitwiseAND(mask)
        return F.array(x, x + 1, x + 2, y, y + 1, y + 2)

    spans = F.when(F.size("__hits") > 0, F.flatten(F.transform("__hits", covered))).otherwise(empty)
    return rows.withColumn("n_repeat_words", F.size(F.array_distinct(spans)).cast("long")).drop(
        "__bits", "__mask", "__keys", "__hits"
    )


def text_statistics(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Counts and rates of every whole text beside the columns ``keep``; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        *keep,
        text.alias("__text"),
        F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)).alias("words"),
    )
    lines = F.filter(F.split("__text", "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    rows = rows.withColumn("__lines", lines)
    rows = rows.select(
        *keep,
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.char_length("__text").cast("long").alias("n_chars"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.regexp_count("__text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("__text", F.lit("[0-9]")).cast("long").alias("n_digits"),
        F.regexp_count("__text", F.lit("[.,;:?]")).cast("long").alias("n_marks"),
        F.regexp_count("__text", F.lit("!")).cast("long").alias("n_shouts"),
    )
    rows = repeated_words(rows).drop("words")

    def rate(part: str, whole: str) -> Column:
        return F.col(part) / F.greatest(F.col(whole), F.lit(1)).cast("double")

    rows = rows.withColumns(
        {
            "mean_word": rate("word_chars", "n_words"),
            "symbol_rate": rate("n_symbols", "n_chars"),
            "dup_line_rate": rate("n_dup_lines", "n_lines"),
            "repeat_rate": rate("n_repeat_words", "n_words"),
            "distinct_rate": rate("n_distinct", "n_words"),
            "upper_rate": rate("n_upper", "n_chars"),
            "digit_rate": rate("n_digits", "n_chars"),
            "mark_rate": rate("n_marks", "n_chars"),
            "shout_rate": rate("n_shouts", "n_chars"),
            "base_failed": (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50),
        }
    )
    # A later filter on a statistic must not be pushed below, where it would compute all of them anew.
    made = [c for c in rows.columns if c not in keep]
    return rows.select(*keep, F.inline(F.array(F.struct(*made))))


@dataclass(frozen=True)
class Condition:
    name: str
    at_least: bool
    value: float

    def holds(self, values: np.ndarray) -> np.ndarray:
        return values >= self.value if self.at_least else values < self.value

    def column(self) -> Column:
        return F.col(self.name) >= self.value if self.at_least else F.col(self.name) < self.value


def covers(rule: Sequence[Condition], rows: dict[str, np.ndarray], size: int) -> np.ndarray:
    held = np.ones(size, bool)
    for condition in rule:
        held &= condition.holds(rows[condition.name])
    return held


def grow(rows: dict[str, np.ndarray], bad: np.ndarray, longest: int) -> list[Condition]:
    """Add the threshold with the most gain in information until only bad rows are covered."""
    rule: list[Condition] = []
    held = np.ones(len(bad), bool)
    while len(rule) < longest and held.any() and not bad[held].all():
        p, n = bad[held].sum(), (~bad[held]).sum()
        best, gain = None, 1e-9
        for name, values in rows.items():
            cuts = np.unique(np.quantile(values[held & bad], np.linspace(0, 1, CUTS)))
            cuts = np.unique(np.concatenate([cuts, np.quantile(values[held & ~bad], [0.0, 0.01, 0.99, 1.0])]))
            for value in cuts.tolist():
                for at_least in (True, False):
                    own = held & Condition(name, at_least, value).holds(values)
                    p1, n1 = bad[own].sum(), (~bad[own]).sum()
                    if p1:
                        found = p1 * (np.log2((p1 + 1) / (p1 + n1 + 2)) - np.log2((p + 1) / (p + n + 2)))
                        if found > gain:
                            best, gain = Condition(name, at_least, value), found
        if best is None:
            break
        rule.append(best)
        held &= best.holds(rows[best.name])
    return rule


def prune(rule: list[Condition], rows: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """The shortest beginning of the rule with the best balance of bad over good on other rows."""

    def worth(length: int) -> float:
        own = covers(rule[:length], rows, len(bad))
        return (bad[own].sum() - (~bad[own]).sum()) / max(1, own.sum())

    return rule[: max(range(1, len(rule) + 1), key=lambda n: (worth(n), -n))] if rule else rule


def widen(rule: list[Condition], rows: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """Thresholds moved halfway to the nearest good row that the rest of the rule leaves in reach."""
    out = list(rule)
    for i, condition in enumerate(rule):
        values = rows[condition.name]
        others = covers([c for j, c in enumerate(out) if j != i], rows, len(bad))
        good = values[others & ~bad & ~condition.holds(values)]
        if len(good):
            nearest = good.max() if condition.at_least else good.min()
            out[i] = Condition(condition.name, condition.at_least, float(condition.value + nearest) / 2)
    return out


def fit_rules(
    rows: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, longest: int = 4, most: int = 16
) -> list[list[Condition]]:
    """Ordered rules for bad rows; a rule must reach ``precision`` on the rows it was pruned on.

    ``most`` ends the list; no bad rows, or none a rule can catch, give an empty list.
    """
    pruning = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), bool)
    rules: list[list[Condition]] = []
    while len(rules) < most:
        own, check = left & ~pruning, left & pruning
        if bad[own].sum() < 2:
            break
        part = {name: values[own] for name, values in rows.items()}
        other = {name: values[check] for name, values in rows.items()}
        rule = prune(grow(part, bad[own], longest), other, bad[check])
        if not rule:
            break
        caught = covers(rule, rows, len(bad)) & left
        shown = bad[caught & pruning] if (caught & pruning).any() else bad[caught]
        if caught.sum() < 2 or shown.mean() < precision:
            break
        rules.append(widen(rule, {name: values[left] for name, values in rows.items()}, bad[left]))
        left &= ~(covers(rules[-1], rows, len(bad)) & left)
    return rules


def verdict(rules: Sequence[Sequence[Condition]]) -> Column:
    """The list as one ordered conditional: false where a rule holds, true otherwise."""
    out = None
    for rule in rules:
        condition = rule[0].column()
        for more in rule[1:]:
            condition = condition & more.column()
        out = F.when(condition, False) if out is None else out.when(condition, False)
    return F.lit(True) if out is None else out.otherwise(True)


def learn_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, precision: float = 0.9) -> list[list[Condition]]:
    """Rules from at most ``sample`` labelled documents (quality 0 is bad; null labels are skipped)."""
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("__quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # Documents that fail the base rules are rejected anyway and teach nothing.
    stats = text_statistics(known, ("doc_id", "__quality")).where("NOT base_failed")
    found = stats.select("doc_id", "__quality", *RATES).collect()
    found.sort(key=lambda r: tuple(r))
    rows = {name: np.array([float(r[name]) for r in found]) for name in RATES}
    return fit_rules(rows, np.array([r["__quality"] == 0 for r in found], bool), precision)


def judge_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, precision: float = 0.9) -> DataFrame:
    """All columns of ``docs`` with the statistics, ``base_failed`` and ``kept`` behind them.

    ``kept`` is false where the base rules fail, else the list's verdict. With no labels, or
    none of them bad, only the base rules reject. Columns of ``docs`` with the name of a
    statistic are replaced by it.
    """
    rules = learn_rules(docs, labels, sample, precision)
    rows = docs.withColumn("__row", F.struct(*[F.col(c) for c in docs.columns]))
    stats = text_statistics(rows.select("__row", "text"), ("__row",)).withColumn("kept", ~F.col("base_failed") & verdict(rules))
    new = [c for c in stats.columns if c != "__row"]
    return stats.select(*[F.col("__row")[c].alias(c) for c in docs.columns if c not in new], *new)
