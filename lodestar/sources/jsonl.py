"""JSON-lines sources with lenient field names, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L = T.StringType(), T.LongType()
CHUNK_LINE = T.StructType(
    [T.StructField(n, _S) for n in ("chunk_id", "repo_id", "repo", "path", "sha256", "content_sha256", "layer", "artifact_type", "language", "content", "source_file")]
    + [T.StructField(n, _L) for n in ("start_line", "end_line", "start_byte", "end_byte", "size", "size_bytes")]
    + [T.StructField("_corrupt", _S)]
)
INVENTORY_LINE = T.StructType(
    [T.StructField(n, _S) for n in ("rel_path", "name", "ext", "mtime", "quick_hash", "checksum", "mime_type", "encoding")]
    + [T.StructField(n, _L) for n in ("size_bytes", "allocated_size_bytes", "inode", "device", "line_count")]
    + [T.StructField(n, T.BooleanType()) for n in ("is_symlink", "is_sparse", "is_text", "is_huge")]
    + [T.StructField("_corrupt", _S)]
)


def _lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk lines with aliases resolved and ``line_status``: ok, invalid_json or missing_id."""
    rows = _lines(spark, path, CHUNK_LINE)
    status = F.when(F.col("_corrupt").isNotNull(), "invalid_json").when(F.coalesce("chunk_id", F.lit("")) == "", "missing_id").otherwise("ok")
    return rows.select(
        "chunk_id", F.coalesce("repo_id", "repo").alias("repo_id"), "path", "start_line", "end_line", "start_byte", "end_byte",
        F.coalesce("content_sha256", "sha256").alias("content_sha256"), F.coalesce("size_bytes", "size").alias("size_bytes"),
        "layer", "artifact_type", "language", "content", "source_file", status.alias("line_status"),
    )


def ingest_counters(rows: DataFrame) -> DataFrame:
    """Lines per status: malformed ones are counted, not dropped silently."""
    return rows.groupBy("line_status").agg(F.count("*").alias("n_lines"))


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """One row per rel_path; of several lines of a path the last one of the file holds."""
    rows = _lines(spark, path, INVENTORY_LINE).where("_corrupt is null and rel_path is not null").withColumns({"_file": F.input_file_name(), "_at": F.monotonically_increasing_id()})
    w = Window.partitionBy("rel_path").orderBy(F.desc("_file"), F.desc("_at"))
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_file", "_at", "_corrupt")


def write_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def publish(rows: DataFrame, root: str, generation: str) -> str:
    """Write a generation beside the others and only then add a pointer to it.

    Pointers are appended, never replaced, and the latest whole one holds: a job that is lost while it
    writes either leaves the old one in force; a repeated one writes the same generation again.
    """
    spark = rows.sparkSession
    target = f"{root}/generations/{generation}"
    rows.write.mode("overwrite").parquet(target)
    pointer = spark.range(1).select(F.unix_micros(F.current_timestamp()).alias("at"), F.lit(generation).alias("generation"), F.lit(target).alias("path"))
    pointer.coalesce(1).write.mode("append").parquet(f"{root}/pointers")
    return target


def current(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(spark.read.parquet(f"{root}/pointers").orderBy(F.desc("at"), F.desc("generation")).first()["path"])
