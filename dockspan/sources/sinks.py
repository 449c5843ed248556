"""Writing ranked results and run metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


# Columns of a result table.
RESULT_COLUMNS = ["compound_id", "ps", "pb", "score", "rank"]
POSE_COLUMNS = ["selected_pose", "total_poses"]


def write_results(
    results: DataFrame,
    path: str,
    aggregated: bool = False,
    extra: Sequence[str] = (),
    partition_by: Sequence[str] = ("target",),
    fmt: str = "parquet",
    max_records_per_file: int = 5_000_000,
) -> None:
    """Write result rows below ``path`` with one folder per target.

    The whole table is also the combined result of all targets. Each task
    writes its own rows, so a large target is spread over many files.
    """
    columns = [*RESULT_COLUMNS, *(POSE_COLUMNS if aggregated else []), *extra]
    writer = (
        results.select(*partition_by, *columns)
        .write.mode("errorifexists")
        .option("maxRecordsPerFile", max_records_per_file)
        .partitionBy(*partition_by)
        .format(fmt)
    )
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def run_metadata(
    results: DataFrame,
    models: Mapping[str, str],
    weights: Mapping[str, float],
    aggregated: bool = False,
) -> DataFrame:
    """One row on a run: time, models, weights, whether poses were merged, rows."""
    return results.agg(F.count(F.lit(1)).alias("total_compounds")).select(
        F.current_timestamp().alias("generated_at"),
        *[F.lit(v).alias(f"{k}_model") for k, v in models.items()],
        *[F.lit(float(v)).alias(f"{k}_weight") for k, v in weights.items()],
        F.lit(aggregated).alias("poses_aggregated"),
        "total_compounds",
    )


def write_metadata(meta: DataFrame, path: str) -> None:
    """Store a run's row beside its results; readers of the results pass it over."""
    meta.write.mode("errorifexists").parquet(f"{path}/_run")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/_run")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


