"""Session defaults and the folder for checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(cpus: str = "8", shuffle_partitions: str = "8") -> SparkSession:
    """A local session with the settings the operators assume (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lodestar")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only on a single machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return os.path.join(tempfile.gettempdir(), "lodestar-checkpoints")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a written table in the shared folder: smaller than a checkpoint and read by column."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``stored``, and how many rows were written, counted on the way."""
    seen = Observation()
    table = stored(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return table, seen.get["n"]


def broadcast_if_small(keys: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Narrow key rows, marked for broadcast only if a count proves that they are few; else as they are."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys
