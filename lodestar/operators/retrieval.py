"""Lexical index and ranked queries over chunks.

The index is three tables: postings (doc, term, tf), doc lengths and term frequencies. A query is
a small table (query_id, group_id, term): a document matches if it holds a term of each group.
Scores follow the BM25 of the full-text engine: k1 1.2, b 0.75, idf floored, lower is better.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def path_norm(path: Column | str) -> Column:
    c = F.col(path) if isinstance(path, str) else path
    return F.lower(F.translate(c, "\\", "/"))


def path_tokens(path: Column | str) -> Column:
    """Lower-cased path with separators as blanks."""
    return F.translate(path_norm(path), "/._-", "    ")


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def postings(docs: DataFrame, doc: str, *texts: str) -> DataFrame:
    """(doc, term, tf) over the given text columns together; null texts count as empty."""
    joined = F.concat_ws(" ", *[F.coalesce(F.col(t), F.lit("")) for t in texts])
    return docs.select(F.col(doc).alias("doc"), F.explode(terms(joined)).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))


def doc_lengths(posts: DataFrame) -> DataFrame:
    return posts.groupBy("doc").agg(F.sum("tf").alias("dl"))


def term_statistics(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25_scores(posts: DataFrame, queries: DataFrame, n_docs: Column | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """(query_id, doc, score) of the documents that match all groups of a query.

    Only postings of query terms are scored; lengths are joined to the matched documents. N is the
    number of documents with a term, or ``n_docs``. With ``lengths`` of all documents given, ``posts``
    may hold the query's terms only.
    """
    lengths = lengths if lengths is not None else doc_lengths(posts)
    wanted = queries.select("term").distinct()
    hits = posts.join(wanted, "term", "left_semi")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    need = queries.groupBy("query_id").agg(F.count_distinct("group_id").alias("n_groups"))
    q = queries.distinct().join(df, "term").withColumn("stats", stats.select(F.struct("n", "avgdl").alias("s")).scalar())
    q = q.select("*", "stats.n", "stats.avgdl").drop("stats")
    n = n_docs if n_docs is not None else F.col("n")
    q = q.withColumn("idf", F.greatest(F.lit(IDF_FLOOR), F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))))
    rows = hits.join(q, "term").join(lengths, "doc")
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = rows.groupBy("query_id", "doc").agg((-F.sum(weight)).alias("score"), F.count_distinct("group_id").alias("got"))
    # rounded far below any real difference, so that the order doesn't hang on the order of sums
    return scored.join(need, "query_id").where("got = n_groups").select("query_id", "doc", F.round("score", 12).alias("score"))


def top_k(rows: DataFrame, k: int, partition: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First k rows per partition in a total order, with their rank."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def predicates(repo: str | None = None, path: str | None = None, ext: str | None = None, layer: str | None = None, artifact_type: str | None = None) -> Column:
    """The metadata filters of a query, all pushed to the scan where they are equalities."""
    out = F.lit(True)
    if repo:
        out = out & (F.col("repo_id") == repo)
    if path:
        out = out & path_norm("path").like(f"%{path.lower()}%")
    if ext:
        out = out & path_norm("path").like(f"%.{ext.lower().lstrip('.')}")
    if layer:
        out = out & (F.col("layer") == layer)
    if artifact_type:
        out = out & (F.col("artifact_type") == artifact_type)
    return out


def exclude_paths(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Exact path exclusion before any order or limit."""
    return rows.join(paths.select("path").distinct(), "path", "left_anti")


def graph_boost(hits: DataFrame, distances: DataFrame, w_bm25: float = 0.65, w_graph: float = 0.20, w_entry: float = 0.15, test_penalty: float = 0.75) -> DataFrame:
    """Rerank: (w_b * bm25_norm + min(w_g / (d + 1) + w_e [d = 0], w_g + w_e)) * penalty of tests.

    ``distances``: (repo_id, path, distance) from the entry points; the greatest score of a query is aggregated, not windowed.
    """
    best = hits.groupBy("query_id").agg(F.max(F.abs("score")).alias("best"))
    rows = hits.join(best, "query_id").join(distances, ["repo_id", "path"], "left").withColumn("distance", F.coalesce("distance", F.lit(-1)))
    norm = F.coalesce(F.try_divide(F.abs("score"), F.col("best")), F.lit(0.0))
    near = F.when(F.col("distance") >= 0, 1 / (F.col("distance") + 1)).otherwise(0.0)
    bonus = F.least(w_graph * near + F.when(F.col("distance") == 0, w_entry).otherwise(0.0), F.lit(w_graph + w_entry))
    is_test = F.coalesce(F.col("layer") == "test", F.lit(False)) | F.lower("path").contains("test")
    final = (w_bm25 * norm + bonus) * F.when(is_test, test_penalty).otherwise(1.0)
    return rows.withColumns({"bm25_norm": F.round(norm, 6), "final_score": F.round(final, 6)})


def federated_top_k(hits: DataFrame, bundle: str, k_each: int, k: int, order: Sequence[Column]) -> DataFrame:
    """Best k of the best k_each per bundle."""
    each = top_k(hits, k_each, [bundle], order).withColumnRenamed("rank", "bundle_rank")
    return each.orderBy(*order).limit(k)


def filename_conflicts(hits: DataFrame, bundle: str) -> DataFrame:
    """File names that stand for more than one distinct (bundle, path)."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    return (
        hits.select(name.alias("file_name"), F.col(bundle).alias("bundle"), "path").distinct()
        .groupBy("file_name").agg(F.count("*").alias("n_places"), F.count_distinct("bundle").alias("n_bundles")).where("n_places > 1")
    )


def cross_links(hits: DataFrame, bundle: str, key: str, most: int = 5) -> DataFrame:
    """Pairs of bundles (i < j) that both answer a query, with their first evidence ids."""
    each = hits.groupBy("query_id", F.col(bundle).alias("b")).agg(F.slice(F.array_sort(F.collect_set(key)), 1, most).alias("ids"))
    left = each.select("query_id", F.col("b").alias("left_bundle"), F.col("ids").alias("left_ids"))
    right = each.select("query_id", F.col("b").alias("right_bundle"), F.col("ids").alias("right_ids"))
    return left.join(right, "query_id").where("left_bundle < right_bundle")


def unique_paths(hits: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """Best hit per (query, path), then the best k per query."""
    first = top_k(hits, 1, ["query_id", "path"], order).drop("rank")
    return top_k(first, k, ["query_id"], order)


def round_robin(lanes: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Fuse lanes by turns (lane_rank, lane_order), keep the first of each path, score 1 / rank."""
    ranked = lanes.withColumn("lane_rank", F.row_number().over(Window.partitionBy("query_id", "lane_order").orderBy(*order)))
    turn = [F.col("lane_rank"), F.col("lane_order")]
    first = top_k(ranked, 1, ["query_id", "path"], turn).drop("rank")
    out = first.withColumn("global_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*turn)))
    return out.withColumn("final_score", F.round(1 / F.col("global_rank"), 6))


def window_context(chunks: DataFrame, targets: DataFrame) -> DataFrame:
    """Chunks of a target's file whose lines overlap its interval; hash join on repository and path."""
    t = targets.select("repo_id", "path", F.col("start_line").alias("t_start"), F.col("end_line").alias("t_end"))
    return chunks.join(t, ["repo_id", "path"]).where("start_line <= t_end and end_line >= t_start")


def file_context(chunks: DataFrame) -> DataFrame:
    """Whole files: chunks of a path joined in line order."""
    parts = F.array_sort(F.collect_set(F.struct("start_line", "chunk_id", F.coalesce("content", F.lit("")).alias("content"))))
    return chunks.groupBy("repo_id", "path").agg(parts.alias("p")).select("repo_id", "path", F.size("p").alias("n_chunks"), F.array_join(F.transform("p", lambda x: x["content"]), "").alias("content"))


def prefix_candidates(posts: DataFrame, prefix: str) -> DataFrame:
    return posts.where(F.col("term").startswith(prefix)).select("doc").distinct()


def index_health(chunks: DataFrame, posts: DataFrame) -> DataFrame:
    """Row counts, content lengths and the coverage of the index."""
    rows = chunks.agg(
        F.count("*").alias("n_rows"), F.count_distinct("chunk_id").alias("n_ids"), F.round(F.avg(F.length("content")), 4).alias("avg_length"),
        F.max(F.length("content")).alias("max_length"), F.count_if(F.col("content").isNull() | (F.length("content") == 0)).alias("n_empty"),
    )
    covered = chunks.select("chunk_id").distinct().join(posts.select(F.col("doc").alias("chunk_id")).distinct(), "chunk_id", "left_semi").agg(F.count("*").alias("n_indexed"))
    return rows.withColumn("n_indexed", covered.scalar())


def row_sum(*columns: str) -> Column:
    """Sum of 60 bits of each row's MD5: as free of order as an exclusive or, but repeats do not cancel."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in columns])
    return F.sum(F.conv(F.substring(F.md5(F.encode(text, "utf-8")), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")


def signature(rows: DataFrame, *columns: str) -> DataFrame:
    """Order-free fingerprint of a table: count and sum of row hashes, no sort and no collect."""
    return rows.agg(F.count("*").alias("n_rows"), row_sum(*columns).alias("fingerprint"))
