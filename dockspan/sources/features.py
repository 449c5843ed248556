"""Feature tables and feature lists on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_feature_csv(
    spark: SparkSession, path: str, schema: StructType | None = None, id_column: str = "Id"
) -> DataFrame:
    """Feature rows from CSV files with a header.

    A declared ``schema`` saves the extra pass that inference needs. Without an
    id column the last column is taken to be the id.
    """
    reader = spark.read.option("header", True).option("comment", "#")
    if schema is not None:
        return reader.schema(schema).csv(path)
    rows = reader.option("inferSchema", True).csv(path)
    if id_column not in rows.columns:
        rows = rows.withColumnRenamed(rows.columns[-1], id_column)
    return rows


def write_feature_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).mode("errorifexists").csv(path)


def read_feature_lists(spark: SparkSession, path: str) -> DataFrame:
    """Named feature lists ``(list_name, ord, feature)`` from a JSON object of arrays."""
    text = spark.read.text(path, wholetext=True)
    lists = F.from_json("value", "map<string, array<string>>")
    return (
        text.select(F.explode(lists).alias("list_name", "features"))
        .select("list_name", F.posexplode("features").alias("ord", "feature"))
    )


def read_atom_keys(spark: SparkSession, path: str) -> DataFrame:
    """Atom-type keys ``(pdb_atom, type_key)`` from a two-column CSV with a header."""
    return spark.read.schema("pdb_atom string, type_key string").option("header", True).csv(path)
