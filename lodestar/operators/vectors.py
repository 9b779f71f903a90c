"""Cosine similarity of array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import top_k


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine with the norm of a zero vector taken as one."""
    norm = lambda v: F.when(_dot(v, v) == 0, 1.0).otherwise(F.sqrt(_dot(v, v)))
    return _dot(a, b) / (norm(a) * norm(b))


def cosine_top_k(queries: DataFrame, rows: DataFrame, k: int, block: int = 2_000) -> DataFrame:
    """Best k rows for each of a stated set of queries (query_id, q), against all rows (row_id, v).

    The queries go out in blocks of about ``block``, each broadcast and met by one pass over the rows, so
    nothing is shuffled to a common key however many there are. Both sides are brought to length one once
    (a zero vector stays zero); vectors of another length than the query's do not meet it.
    """
    unit = lambda df, c: df.withColumn("norm", F.sqrt(_dot(F.col(c), F.col(c)))).withColumn(c, F.transform(c, lambda x: x / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm")))).drop("norm")
    queries, rows = unit(queries, "q"), unit(rows, "v")
    parts = max(1, -(-queries.count() // block))
    best = None
    for i in range(parts):
        some = F.broadcast(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i))
        met = rows.join(some, F.size("q") == F.size("v")).where("row_id <> query_id")
        scored = met.select("query_id", "row_id", F.round(_dot(F.col("q"), F.col("v")), 6).alias("score"))
        one = top_k(scored, k, ["query_id"], [F.desc("score"), F.col("row_id")])
        best = one if best is None else best.unionByName(one)
    return best.select("query_id", "rank", "row_id", "score")
