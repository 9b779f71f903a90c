"""Citations and ranges: what a hit, an answer or a review stands on, and whether that still holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severity of a status, worst last.
SEVERITY = ("valid", "not_comparable", "missing", "drifted")


def content_digest(content: str = "content") -> Column:
    return F.sha2(F.encode(content, "utf-8"), 256)


def hydrate(rows: DataFrame, files: DataFrame) -> DataFrame:
    """The bytes a range names, cut from its file, with a status.

    ``rows``: repo_id, path, start_byte, end_byte (exclusive), sha256; ``files``: repo_id, path, content.
    Status: no_file, bad_range (null, empty, reversed or beyond the file), mismatch, ok.
    """
    f = files.select("repo_id", "path", F.encode("content", "utf-8").alias("_bytes"))
    x = rows.join(f, ["repo_id", "path"], "left")
    size = F.octet_length("_bytes")
    bad = F.col("start_byte").isNull() | F.col("end_byte").isNull() | (F.col("start_byte") < 0) | (F.col("end_byte") <= F.col("start_byte")) | (F.col("end_byte") > size)
    piece = F.when(~bad, F.substring(F.col("_bytes"), F.col("start_byte").cast("int") + 1, (F.col("end_byte") - F.col("start_byte")).cast("int")))
    x = x.withColumn("_piece", piece)
    status = F.when(F.col("_bytes").isNull(), "no_file").when(bad, "bad_range").when(F.sha2("_piece", 256) == F.lower("sha256"), "ok").otherwise("mismatch")
    return x.withColumn("range_status", status).withColumn("text", F.when(status == "ok", F.decode("_piece", "utf-8"))).drop("_bytes", "_piece")


def citation_map(chunks: DataFrame) -> DataFrame:
    """One citation per chunk with a content: stable id, range and digest."""
    sha = content_digest()
    key = F.concat_ws("\n", "repo_id", "path", F.col("start_line").cast("string"), F.col("end_line").cast("string"), sha)
    return chunks.where("content is not null").select(F.concat(F.lit("cit_"), F.substring(F.sha1(F.encode(key, "utf-8")), 1, 16)).alias("citation_id"), "chunk_id", "repo_id", "path", "start_line", "end_line", sha.alias("sha256")).distinct()


def validate_citations(citations: DataFrame) -> DataFrame:
    """Status per citation: duplicate_id, bad_range, no_digest or valid."""
    n = citations.groupBy("citation_id").agg(F.count("*").alias("n_same_id"))
    bad = F.col("start_line").isNull() | F.col("end_line").isNull() | (F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line"))
    status = F.when(F.col("n_same_id") > 1, "duplicate_id").when(bad, "bad_range").when(F.col("sha256").isNull(), "no_digest").otherwise("valid")
    return citations.join(n, "citation_id").withColumn("citation_status", status)


def citation_candidates(hits: DataFrame, citations: DataFrame) -> DataFrame:
    """Citations of a hit by its chunk id or by its exact range; the reasons of a pair are merged and sorted."""
    c = citations.select("citation_id", F.col("chunk_id").alias("c_chunk"), F.col("repo_id").alias("c_repo"), F.col("path").alias("c_path"), F.col("start_line").alias("c_start"), F.col("end_line").alias("c_end"))
    by_id = hits.join(c, F.col("chunk_id") == F.col("c_chunk")).select("hit_id", "citation_id", F.lit("chunk_id").alias("reason"))
    same = (F.col("repo_id") == F.col("c_repo")) & (F.col("path") == F.col("c_path")) & (F.col("start_line") == F.col("c_start")) & (F.col("end_line") == F.col("c_end"))
    by_range = hits.join(c, same).select("hit_id", "citation_id", F.lit("range").alias("reason"))
    return by_id.unionByName(by_range).groupBy("hit_id", "citation_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def range_coverage(hits: DataFrame, candidates: DataFrame) -> DataFrame:
    """Hits per status (exact, by_id_only, by_range_only, none) with shares."""
    best = candidates.groupBy("hit_id").agg(F.bool_or(F.col("reasons") == "chunk_id,range").alias("both"), F.bool_or(F.col("reasons").contains("chunk_id")).alias("by_id"))
    x = hits.select("hit_id").distinct().join(best, "hit_id", "left")
    status = F.when(F.col("both"), "exact").when(F.col("by_id"), "by_id_only").when(F.col("by_id").isNotNull(), "by_range_only").otherwise("none")
    per = x.groupBy(status.alias("status")).agg(F.count("*").alias("n_hits"))
    total = x.agg(F.count("*").alias("n")).select("n")
    return per.withColumn("share", F.round(F.col("n_hits") / total.scalar(), 6))


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old citations beside the new state by (repo_id, path, start_line): valid, drifted, missing or not_comparable."""
    n = new.select("repo_id", "path", "start_line", F.col("sha256").alias("n_sha"), F.lit(True).alias("there")).distinct()
    n = n.groupBy("repo_id", "path", "start_line").agg(F.array_sort(F.collect_set("n_sha")).alias("n_shas"), F.max("there").alias("there"))
    x = old.join(n, ["repo_id", "path", "start_line"], "left")
    status = F.when(F.col("there").isNull(), "missing").when(F.col("sha256").isNull() | (F.size("n_shas") == 0), "not_comparable").when(F.array_contains("n_shas", F.col("sha256")), "valid").otherwise("drifted")
    return x.select("citation_id", "repo_id", "path", status.alias("drift_status"))


def worst_status(rows: DataFrame, group: str, status: str) -> DataFrame:
    """The most severe status of each group."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col(status))
    worst = F.max(F.struct(rank.alias("rank"), F.col(status).alias("s")))
    return rows.groupBy(group).agg(worst.alias("w"), F.count("*").alias("n")).select(group, F.col("w.s").alias("worst"), "n")


def file_parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Equality of two sets of files (path, digest): counts of paths only here, only there, alike and unlike."""
    a, b = left.select("path", F.col("digest").alias("a")), right.select("path", F.col("digest").alias("b"))
    x = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), "path", "full")
    state = F.when(F.col("in_b").isNull(), "only_left").when(F.col("in_a").isNull(), "only_right").when(F.col("a").eqNullSafe(F.col("b")), "equal").otherwise("different")
    return x.groupBy(state.alias("state")).agg(F.count("*").alias("n_paths"))
