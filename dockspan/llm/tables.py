"""Keys for documents and tables kept between steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dockspan.operators.durable import stored  # noqa: F401


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of id and text, which equal rows share; nulls have keys too."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"__id": F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))), "__hash": F.xxhash64(text)})
