"""Source files put together from their chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def source_files(chunks: DataFrame) -> DataFrame:
    """(repo_id, path, content): each file's chunks joined by start_byte.

    Repeated rows count once. Files with a null content in any chunk, and rows without path,
    are left out; a null repo_id is a repository of its own.
    """
    part = F.struct(F.coalesce("start_byte", F.lit(0).cast("bigint")).alias("at"), F.col("content").alias("c"))
    rows = chunks.where("path is not null").groupBy("repo_id", "path").agg(
        F.collect_set(part).alias("parts"), F.max(F.col("content").isNull()).alias("broken")
    )
    content = F.array_join(F.transform(F.array_sort("parts"), lambda p: p["c"]), "")
    return rows.where(~F.col("broken")).select("repo_id", "path", content.alias("content"))
