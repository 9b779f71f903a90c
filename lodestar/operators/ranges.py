"""Line and byte ranges: overlap, union, coverage, packing, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of ranges (a_start, a_end) and (b_start, b_end) of equal keys that overlap; a null range stands for the whole file."""
    whole = F.col("a_start").isNull() | F.col("b_start").isNull()
    return left.join(right, keys).where(whole | ((F.col("a_start") <= F.col("b_end")) & (F.col("a_end") >= F.col("b_start"))))


def islands(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Merged intervals; adjacent ones join (a gap is start > previous end + 1)."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    x = rows.withColumn("_top", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("_new", F.when(F.col("_top").isNull() | (F.col(start) > F.col("_top") + 1), 1).otherwise(0))
    x = x.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*keys, "_island").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("_island")


def coverage(targets: DataFrame, citations: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of each target (a_start, a_end) that citations (b_start, b_end) cover, clipped and counted once."""
    t = targets.select(*keys, "a_start", "a_end").distinct()
    met = overlap_join(t, citations.select(*keys, "b_start", "b_end"), keys)
    clipped = met.select(*keys, "a_start", "a_end", F.greatest("a_start", "b_start").alias("s"), F.least("a_end", "b_end").alias("e"))
    merged = islands(clipped, [*keys, "a_start", "a_end"], "s", "e").groupBy(*keys, "a_start", "a_end").agg(F.sum(F.col("end") - F.col("start") + 1).alias("covered"))
    out = t.join(merged, [*keys, "a_start", "a_end"], "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return out.withColumn("ratio", F.round(F.col("covered") / (F.col("a_end") - F.col("a_start") + 1), 6))


def line_of_byte(content: Column, at: Column) -> Column:
    """Line number of a byte offset of a text: newlines before it plus one."""
    head = F.substring(F.encode(content, "utf-8"), F.lit(1), at)
    return F.length(F.regexp_replace(F.decode(head, "ISO-8859-1"), "[^\\n]", "")) + 1


def verify_content(chunks: DataFrame) -> DataFrame:
    """Status of each chunk's content against its digest and size: ok, mismatch, no_content, no_digest."""
    from ..functions import normal

    want, have = normal.digest("content_sha256"), F.sha2(F.encode("content", "utf-8"), 256)
    status = F.when(F.col("content").isNull(), "no_content").when(want.isNull(), "no_digest").when(want == have, "ok").otherwise("mismatch")
    size = F.when(F.col("size_bytes").isNull() | F.col("content").isNull(), "unknown").when(F.col("size_bytes") == F.octet_length("content"), "ok").otherwise("mismatch")
    return chunks.withColumns({"content_status": status, "size_status": size})


def pack_lines(texts: DataFrame, key: str, text: str, max_bytes: int = 8192, max_lines: int = 400) -> DataFrame:
    """Greedy chunks of whole lines; a line over the bound is a chunk of its own.

    The counters start anew at every cut, which no prefix sum gives: a fold over the lines of one
    text carries (cuts, bytes, lines). Columns: key, chunk_no, start_line, end_line, n_bytes.
    """
    lines = F.split(text, "\n")
    zero = F.struct(F.array().cast("array<struct<s:int,e:int,b:int>>").alias("done"), F.lit(1).alias("s"), F.lit(0).alias("e"), F.lit(0).alias("b"))

    def step(acc: Column, line: Column) -> Column:
        size = F.octet_length(line) + 1
        full = (acc["e"] >= acc["s"]) & ((acc["b"] + size > max_bytes) | (acc["e"] - acc["s"] + 1 >= max_lines))
        cut = F.concat(acc["done"], F.array(F.struct(acc["s"].alias("s"), acc["e"].alias("e"), acc["b"].alias("b"))))
        return F.struct(
            F.when(full, cut).otherwise(acc["done"]).alias("done"), F.when(full, acc["e"] + 1).otherwise(acc["s"]).alias("s"),
            (acc["e"] + 1).alias("e"), F.when(full, size).otherwise(acc["b"] + size).alias("b"),
        )

    last = lambda acc: F.concat(acc["done"], F.array(F.struct(acc["s"].alias("s"), acc["e"].alias("e"), acc["b"].alias("b"))))
    parts = texts.where(F.col(text).isNotNull() & (F.col(text) != "")).select(key, F.posexplode(F.aggregate(lines, zero, step, last)).alias("chunk_no", "p"))
    return parts.select(key, "chunk_no", F.col("p.s").alias("start_line"), F.col("p.e").alias("end_line"), F.col("p.b").alias("n_bytes"))


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """Stable ids from path, first line and content digest."""
    sha = F.sha2(F.encode("content", "utf-8"), 256)
    return chunks.where("content is not null").select("chunk_id", F.substring(F.sha1(F.encode(F.concat_ws("\n", "path", F.col("start_line").cast("string"), sha), "utf-8")), 1, 20).alias("stable_id"))


def cumulative_offsets(chunks: DataFrame) -> DataFrame:
    """Byte offsets of a file's chunks from the sizes of those before, beside the stated ones."""
    w = Window.partitionBy("repo_id", "path").orderBy("start_line", "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("offset", F.coalesce(F.sum(F.octet_length("content")).over(w), F.lit(0)))
