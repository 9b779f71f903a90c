"""Streams run to their end and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming.watch import event_windows, ingest_once, run_to_table, watched


def stream_tumbling_windows(spark, base):
    out = run_to_table(event_windows(watched(spark, base, "events")), "complete")
    return spark.read.parquet(out).withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_ingest_once(spark, base):
    rows = ingest_once(watched(spark, base, "chunks").select("chunk_id", "repo_id", "batch_no", "ingested_at"), "chunk_id", "3650 days")
    return spark.read.parquet(run_to_table(rows)).groupBy("repo_id").agg(F.count("*").alias("n_chunks"))


QUERIES = {f.__name__: f for f in (stream_tumbling_windows, stream_ingest_once)}
SQL = {
    "stream_tumbling_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_ingest_once": "SELECT repo_id, count(DISTINCT chunk_id) AS n_chunks FROM chunks GROUP BY 1",
}
