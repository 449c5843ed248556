"""Result sinks and streams, read back and compared with batch results."""

from __future__ import annotations

from dockspan.operators import consensus
from dockspan.operators.durable import scratch_table
from dockspan.operators.sizing import spread
from dockspan.queries.registry import query, rounded
from dockspan.queries.scoring import BEST, KEY_SQL, SCORED, best, scored
from dockspan.queries.views import POSE_KEY, POSE_SCORES, bound_view, table
from dockspan.sources import sinks
from dockspan.streaming import ingest

BATCHES = 3


@query(
    "result_sink",
    SCORED
    + f"""SELECT target, compound_id, round(ps, 6) AS ps, round(pb, 6) AS pb,
      round(score, 6) AS score,
      row_number() OVER (PARTITION BY target ORDER BY score DESC, {KEY_SQL}) AS rank FROM scored""",
)
def result_sink(spark, sf_dir):
    path = scratch_table(spark, "results")
    ranked = consensus.rank_by_score(scored(spark, sf_dir), ties=POSE_KEY)
    sinks.write_results(ranked, path)
    return rounded(sinks.read_results(spark, path))


@query(
    "run_metadata",
    SCORED
    + BEST
    + """SELECT 'ps-model' AS ps_model, 'pb-model' AS pb_model, CAST(0.7 AS DOUBLE) AS ps_weight,
      CAST(0.3 AS DOUBLE) AS pb_weight, TRUE AS poses_aggregated, count(*) AS total_compounds
    FROM best""",
)
def run_metadata(spark, sf_dir):
    meta = sinks.run_metadata(
        best(spark, sf_dir), {"ps": "ps-model", "pb": "pb-model"}, {"ps": 0.7, "pb": 0.3}, True
    )
    path = scratch_table(spark, "run")
    sinks.write_metadata(meta, path)
    return sinks.read_metadata(spark, path).drop("generated_at")


def streamed_scores(spark, sf_dir):
    # The table as files of one split each, a third of them for each micro-batch.
    source = spread(table(spark, sf_dir, "lineitem"))
    path = scratch_table(spark, "incoming")
    source.write.parquet(path)
    files = len(spark.read.parquet(path).inputFiles())
    rows = ingest.read_stream(spark, path, source.schema, pattern="*.parquet", max_files=max(1, -(-files // BATCHES)))
    poses = bound_view(spark, POSE_SCORES, lineitem=rows)
    return consensus.with_consensus(poses)


@query(
    "stream_ingest",
    SCORED
    + "SELECT target, compound_id, l_partkey, round(score, 6) AS score FROM scored",
)
def stream_ingest(spark, sf_dir):
    output, state = scratch_table(spark, "ingest"), scratch_table(spark, "state")
    rows = rounded(
        streamed_scores(spark, sf_dir).select("target", "compound_id", "l_partkey", "score")
    )
    # The second start finds no new file and adds nothing.
    for _ in range(2):
        ingest.ingest(rows, output, state).awaitTermination()
    return spark.read.parquet(output)


@query(
    "stream_best_pose",
    SCORED
    + BEST
    + """SELECT target, base_compound, compound_id, round(score, 6) AS score, total_poses FROM best""",
)
def stream_best_pose(spark, sf_dir):
    kept = ingest.LatestRows(scratch_table(spark, "updates"), ["target", "base_compound"], every=2)
    updates = ingest.running_best(streamed_scores(spark, sf_dir), first=POSE_KEY)
    ingest.write_updates(updates, kept, scratch_table(spark, "state")).awaitTermination()
    return rounded(kept.rows(spark))
