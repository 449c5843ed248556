"""Streams: reading each file once and keeping the best pose up to date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from dockspan.functions.ids import base_compound
from dockspan.operators.consensus import best_first


def read_stream(
    spark: SparkSession,
    path: str,
    schema: StructType,
    fmt: str = "parquet",
    pattern: str | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """A file stream: every file is read once, however often the job is started."""
    reader = spark.readStream.schema(schema).format(fmt)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def ingest(rows: DataFrame, output: str, state: str) -> StreamingQuery:
    """Append what is new to the table at ``output`` and stop.

    ``state`` records the files already taken; a restarted run continues there.
    """
    return (
        rows.writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", state)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def running_best(
    scores: DataFrame,
    group: Sequence[str] = ("target",),
    score: str = "score",
    first: Sequence[str] = ("compound_id",),
    compound_id: str = "compound_id",
    compound: Column | None = None,
) -> DataFrame:
    """Best pose and pose count of each compound, as a streaming aggregate.

    The state is one row per compound.
    """
    base = base_compound(F.col(compound_id)) if compound is None else compound
    order = F.struct(*best_first(score), *[F.col(c) for c in first])
    kept = F.struct(F.col(compound_id), F.col(score))
    return (
        scores.groupBy(*group, base.alias("base_compound"))
        .agg(F.min_by(kept, order).alias("_best"), F.count(F.lit(1)).alias("total_poses"))
        .select(
            *group,
            "base_compound",
            F.col("_best")[compound_id].alias(compound_id),
            F.col("_best")[score].alias(score),
            "total_poses",
        )
    )


class LatestRows:
    """The newest row of every key, kept in a folder of bounded size.

    A micro-batch writes its changed rows to one of ``2 * every`` folders in turn, and
    every ``every``-th batch merges the newest snapshot and the updates since into the
    older of two snapshot folders. Overwriting is what removes old files. A note
    that a snapshot is complete is written last, so a broken merge leaves the
    other snapshot and its updates in use, and a batch that is run again writes
    the same rows to the same place.
    """

    def __init__(self, output: str, keys: Sequence[str], every: int = 8):
        self.output, self.keys, self.every = output, list(keys), every

    def write_batch(self, rows: DataFrame, number: int) -> None:
        self._write(rows.withColumn("_batch", F.lit(number).cast("bigint")), f"updates/{number % (2 * self.every)}")
        if number % self.every == self.every - 1:
            side = number // self.every % 2
            merged = self._newest(rows.sparkSession, number)
            self._write(merged, f"snapshots/{side}")
            note = rows.sparkSession.range(1).select(F.lit(number).cast("bigint").alias("upto"), F.lit(side).alias("side"))
            self._write(note, f"notes/{side}")

    def rows(self, spark: SparkSession) -> DataFrame:
        """The newest row of every key, of the last complete batch and those before it."""
        return self._newest(spark, None).drop("_batch")

    def _write(self, rows: DataFrame, place: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.output}/{place}")

    def _newest(self, spark: SparkSession, number: int | None) -> DataFrame:
        """Newest rows as of batch ``number``, from the newest snapshot of an earlier batch."""
        updates = spark.read.parquet(f"{self.output}/updates/*")
        upto, parts = -1, []
        held = updates.agg(F.max("_batch").alias("last")).first()["last"]
        last = number if number is not None else -1 if held is None else held
        if last >= self.every:
            notes = spark.read.parquet(f"{self.output}/notes/*")
            if number is not None:
                notes = notes.filter(F.col("upto") < number)
            note = notes.orderBy(F.desc("upto")).first()
            upto = note["upto"]
            parts.append(spark.read.parquet(f"{self.output}/snapshots/{note['side']}"))
        fresh = updates.filter((F.col("_batch") > upto) & (F.col("_batch") <= last))
        for part in parts:
            fresh = fresh.unionByName(part)
        rest = [c for c in fresh.columns if c not in self.keys]
        newest = fresh.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_row"))
        return newest.select(*self.keys, "_row.*")


def write_updates(updates: DataFrame, kept: LatestRows, state: str) -> StreamingQuery:
    """Bring ``kept`` up to date with the changed rows of each micro-batch."""
    return (
        updates.writeStream.foreachBatch(kept.write_batch)
        .option("checkpointLocation", state)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
