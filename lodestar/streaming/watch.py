"""Structured Streaming: watched folders, idempotent ingestion and event windows."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


def watched(spark: SparkSession, base: str, name: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the Parquet files of a table; new files are picked up as they arrive."""
    path = f"{base}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if os.path.isfile(path):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(base)
    return reader.parquet(path)


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and type; rows later than ``late`` behind the newest are dropped by the watermark."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = e.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def ingest_once(stream: DataFrame, key: str, late: str = "30 days", time: str = "ingested_at") -> DataFrame:
    """Rows of a stream without repeats of a key."""
    s = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return s.dropDuplicatesWithinWatermark([key])


def run_to_table(stream: DataFrame, mode: str = "append", target: str | None = None) -> str:
    """Run a stream over all that is there into a table of the shared folder.

    Each micro-batch has a folder of its own named by its id and overwrites it, so a batch that is
    repeated after a failure leaves the same rows. Complete results replace the one before.
    """
    spark = stream.sparkSession
    root = target or f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/{'all' if mode == 'complete' else f'batch={number}'}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return f"{root}/rows/all" if mode == "complete" else f"{root}/rows"
