"""Cutting lineage in storage that outlives an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a fresh temporary
    folder; on a cluster a machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def scratch_table(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder for a written table."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows as a compressed table in the shared folder, with a lineage of their own.

    Partitions and their order are not kept; :func:`durable` keeps them, at several times the bytes.
    """
    path = scratch_table(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and start a new lineage from the stored rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
