"""Files of a streamed table."""

import pytest
from pyspark.sql import functions as F

from dockspan.queries import sinks_streams
from dockspan.streaming import ingest


def test_stream_files_follow_the_input(spark, tmp_path, monkeypatch):
    # Twelve splits of input: as many files, still three batches.
    spark.range(1200).select(F.col("id").alias("l_orderkey")).repartition(12).write.parquet(str(tmp_path / "lineitem.parquet"))
    seen = {}

    def read_stream(session, path, schema, **given):
        seen.update(given, files=len(session.read.parquet(path).inputFiles()))
        raise KeyboardInterrupt

    monkeypatch.setattr(ingest, "read_stream", read_stream)
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        with pytest.raises(KeyboardInterrupt):
            sinks_streams.streamed_scores(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert seen["files"] == 12 and seen["max_files"] == 4
