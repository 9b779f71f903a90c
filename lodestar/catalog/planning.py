"""Planned questions, fair orders and measures of two routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import planning as P
from ..operators import retrieval as R
from ..session import stored
from ..sources.tables import table
from .retrieval import _GR, _H, _ORD, _document_index, _gold_ranks, _hits, _order, chunks

PHRASE = "read back"


def _questions(spark, base):
    extra = spark.createDataFrame([("x1", "Where is the config of the index?"), ("x2", "how do"), ("x3", "error OR auth token"), ("x4", "Run the test_suite main entry"), ("x5", None), ("x6", "database design NEAR settings"), ("x7", "Show evidence settings"), ("x8", "index snapshot")], "item_id string, query_text string")
    return table(spark, base, "goldset", "item_id", "query_text").distinct().unionByName(extra)


def query_routing(spark, base):
    return P.route(_questions(spark, base)).select("item_id", "intent", F.array_join("kept", " ").alias("kept"), "fts_query", "synonyms")


def relaxed_queries(spark, base):
    return _questions(spark, base).select("item_id", P.relaxed(F.col("query_text")).alias("relaxed"))


def path_terms(spark, base):
    c = chunks(spark, base, "path").distinct()
    return c.select(F.explode(P.path_terms(F.col("path"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def phrase_match(spark, base):
    return P.phrase_documents(chunks(spark, base, "chunk_id", "content"), "chunk_id", "content", PHRASE)


def path_column_filter(spark, base):
    """Chunks whose path, not whose text, holds a term."""
    c = chunks(spark, base, "chunk_id", "path").withColumn("terms", P.path_terms(F.col("path")))
    return c.where(F.array_contains("terms", "core")).select("chunk_id").distinct()


def routed_topk(spark, base):
    """Questions planned, with their synonyms, and ranked over the documents."""
    q = P.query_terms(P.route(_questions(spark, base).where("item_id like 'x%'")), "item_id")
    hits = _document_index(spark, base).scores(q)
    return R.top_k(hits, 10, ["query_id"], [F.col("score"), F.col("doc")]).select("query_id", "rank", "doc", F.round("score", 6).alias("score"))


def human_sizes(spark, base):
    f = table(spark, base, "files", "entry_id", "size_bytes").distinct().where("size_bytes is not null")
    s = P.human_size(F.col("size_bytes"))
    return f.select("entry_id", s.alias("shown"), P.parse_size(s).alias("parsed"))


def blob_ids(spark, base):
    """Content addresses of blobs: SHA-1 over a header with the length and the bytes."""
    c = chunks(spark, base, "chunk_id", "content").where("content is not null")
    data = F.encode("content", "utf-8")
    head = F.encode(F.concat(F.lit("blob "), F.octet_length("content").cast("string"), F.lit("\x00")), "utf-8")
    return c.select("chunk_id", F.sha1(F.concat(head, data)).alias("blob"))


def language_fair_order(spark, base):
    c = chunks(spark, base, "chunk_id", "language")
    h = _hits(spark, base).join(c.groupBy("chunk_id").agg(F.min("language").alias("language")), "chunk_id").withColumn("points", F.floor(-F.col("score")))
    return P.fair_interleave(h, "query_id", "points", "language", "chunk_id").where("rank <= 20").select("query_id", "rank", "language", "chunk_id", "points")


def bundle_roles(spark, base):
    """The bundle of the best hit of a query is primary, all others that answer are secondary."""
    h = R.top_k(_hits(spark, base), 20, ["query_id"], _order())
    best = h.where("rank = 1").select("query_id", F.col("repo_id").alias("primary"))
    r = h.groupBy("query_id", "repo_id").agg(F.min("rank").alias("best_rank"), F.count("*").alias("n_hits")).join(best, "query_id")
    return r.select("query_id", "repo_id", "best_rank", "n_hits", F.when(F.col("repo_id") == F.col("primary"), "primary").otherwise("secondary").alias("role"))


def lane_first_n(spark, base):
    """The first three of each lane by priority."""
    lane = F.when(F.col("layer") == "core", "core").when(F.col("layer") == "test", "test").otherwise("rest")
    h = _hits(spark, base).withColumn("lane", lane)
    return R.top_k(h, 3, ["query_id", "lane"], _order()).select("query_id", "lane", "rank", "chunk_id")


def hits_with_provenance(spark, base):
    """Hits without a line range are dropped, the others projected to what a reader needs."""
    h = _hits(spark, base).where("start_line is not null and end_line is not null")
    return h.select("query_id", F.concat_ws(":", "path", F.concat_ws("-", "start_line", "end_line")).alias("range_ref"), "chunk_id")


def union_of_lanes(spark, base):
    """Candidates of several lanes put together, each with the lanes it came by."""
    h = _hits(spark, base).select("query_id", "chunk_id").withColumn("lane", F.lit("text"))
    c = chunks(spark, base, "chunk_id", "path").where(F.lower("path").contains("catalog")).select(F.lit("q1").alias("query_id"), "chunk_id", F.lit("path").alias("lane"))
    return h.unionByName(c).groupBy("query_id", "chunk_id").agg(F.array_join(F.array_sort(F.collect_set("lane")), ",").alias("lanes"))


def suffix_matched_ranks(spark, base):
    """First rank at which a hit's path equals, or ends with, a path that a query expects."""
    h = R.top_k(_hits(spark, base), 10, ["query_id"], _order())
    wanted = chunks(spark, base, "path").where("path like '%.md'").distinct().select(F.explode(F.array(F.lit("q1"), F.lit("q2"))).alias("query_id"), F.concat(F.lit("/"), F.element_at(F.split("path", "/"), -1)).alias("tail")).distinct()
    x = h.withColumn("tail", F.concat(F.lit("/"), F.element_at(F.split("path", "/"), -1))).join(wanted, ["query_id", "tail"])
    return x.groupBy("query_id").agg(F.min("rank").alias("first_rank"), F.count_distinct("path").alias("n_paths"))


def promotion_gate(spark, base):
    """Measures at three beside measures at ten: held or not, and whether all are."""
    ranks = stored(_gold_ranks(spark, base)[0])
    def report(k):
        hit = F.avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0))
        mrr = F.avg(F.when(F.col("first_rank") <= k, 1 / F.col("first_rank")).otherwise(0.0))
        x = ranks.agg(F.round(hit, 6).alias("recall"), F.round(mrr, 6).alias("mrr"))
        return x.select(F.explode(F.array(F.struct(F.lit("recall").alias("metric"), F.col("recall").alias("value")), F.struct(F.lit("mrr").alias("metric"), F.col("mrr").alias("value")))).alias("m")).select("m.*")
    return P.gate(report(3), report(10))


QUERIES = {f.__name__: f for f in (query_routing, relaxed_queries, path_terms, phrase_match, path_column_filter, routed_topk, human_sizes, blob_ids, language_fair_order, bundle_roles, lane_first_n, hits_with_provenance, union_of_lanes, suffix_matched_ranks, promotion_gate)}

_V = ", ".join(f"('{k}', ['{k}', " + ", ".join(f"'{w}'" for w in v) + "])" for k, v in P.SYNONYMS.items())
_ITEMS = """WITH it AS (SELECT DISTINCT item_id, query_text FROM goldset UNION ALL SELECT * FROM (VALUES ('x1', 'Where is the config of the index?'), ('x2', 'how do'), ('x3', 'error OR auth token'), ('x4', 'Run the test_suite main entry'), ('x5', NULL), ('x6', 'database design NEAR settings'), ('x7', 'Show evidence settings'), ('x8', 'index snapshot')) v),
tk AS (SELECT item_id, regexp_extract_all(lower(coalesce(query_text, '')), '[\\p{L}\\p{N}\\p{M}_]+') AS t FROM it)"""
_ROUTE = _ITEMS + ", syn AS (SELECT * FROM (VALUES " + _V + ") v(k, ws)),\nkp AS (SELECT item_id, t, CASE WHEN len(list_filter(t, lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in P.STOPWORDS) + "))) > 0 THEN list_filter(t, lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in P.STOPWORDS) + """)) ELSE t END AS kept FROM tk),
ex AS (SELECT item_id, i, kept[i] AS w FROM (SELECT item_id, kept, unnest(range(1, len(kept) + 1)) AS i FROM kp)),
exs AS (SELECT item_id, i, w, coalesce(ws, [w]) AS ws FROM ex LEFT JOIN syn ON k = w)"""
_INTENT = "CASE coalesce((SELECT arg_min(i, p) FROM (VALUES " + ", ".join(f"({i}, list_min(list_filter([" + ", ".join(f"coalesce(list_position(t, '{w}'), 0)" for w in ws) + "], lambda x: x > 0)))" for i, ws in enumerate(P.INTENTS.values())) + ") v(i, p) WHERE p IS NOT NULL), -1) " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(P.INTENTS)) + " ELSE 'unknown' END"
_RES = ", ".join(f"'{w}'" for w in P.RESERVED)
SQL = {
    "query_routing": _ROUTE + f""", g AS (SELECT item_id, string_agg(CASE WHEN len(ws) > 1 THEN '(' || array_to_string(list_transform(ws, lambda x: CASE WHEN x IN ({_RES}) THEN '"' || x || '"' ELSE x END), ' OR ') || ')' WHEN w IN ({_RES}) THEN '"' || w || '"' ELSE w END, ' AND ' ORDER BY i) AS fts_query,
array_to_string(list_sort(list_distinct(flatten(list(ws[2:])))), ',') AS synonyms FROM exs GROUP BY 1)
SELECT kp.item_id, {_INTENT} AS intent, array_to_string(kept, ' ') AS kept, coalesce(fts_query, '') AS fts_query, coalesce(synonyms, '') AS synonyms FROM kp LEFT JOIN g USING (item_id)""",
    "path_terms": "SELECT term, count(*) AS n FROM (SELECT unnest(string_split(lower(regexp_replace(path, '[^0-9A-Za-z]+', ' ', 'g')), ' ')) AS term FROM (SELECT DISTINCT path FROM chunks)) WHERE term <> '' GROUP BY 1",
    "phrase_match": f"SELECT DISTINCT chunk_id FROM chunks WHERE contains(' ' || array_to_string(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ', ' {PHRASE} ')",
    "path_column_filter": "SELECT DISTINCT chunk_id FROM chunks WHERE list_contains(string_split(lower(regexp_replace(path, '[^0-9A-Za-z]+', ' ', 'g')), ' '), 'core')",
    "blob_ids": "SELECT DISTINCT chunk_id, sha1(encode('blob ' || strlen(content)) || '\\x00'::BLOB || encode(content)) AS blob FROM chunks WHERE content IS NOT NULL",
    "language_fair_order": _H + """, la AS (SELECT chunk_id, min(language) AS language FROM chunks GROUP BY 1), p AS (SELECT query_id, chunk_id, language, CAST(floor(-score) AS BIGINT) AS points FROM hits JOIN la USING (chunk_id)),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id, points, language ORDER BY chunk_id) AS turn FROM p) SELECT query_id, rank, language, chunk_id, points FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, turn, language NULLS LAST, chunk_id) AS rank FROM t) WHERE rank <= 20""",
    "bundle_roles": _H + f""", t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_ORD}) AS rank FROM hits) WHERE rank <= 20), b AS (SELECT query_id, repo_id AS p FROM t WHERE rank = 1)
SELECT t.query_id, repo_id, min(rank) AS best_rank, count(*) AS n_hits, CASE WHEN repo_id = any_value(p) THEN 'primary' ELSE 'secondary' END AS role FROM t JOIN b USING (query_id) GROUP BY 1, 2""",
    "lane_first_n": _H + f", l AS (SELECT *, CASE WHEN layer = 'core' THEN 'core' WHEN layer = 'test' THEN 'test' ELSE 'rest' END AS lane FROM hits) SELECT query_id, lane, rank, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lane ORDER BY {_ORD}) AS rank FROM l) WHERE rank <= 3",
    "hits_with_provenance": _H + " SELECT query_id, path || ':' || start_line || '-' || end_line AS range_ref, chunk_id FROM hits WHERE start_line IS NOT NULL AND end_line IS NOT NULL",
    "union_of_lanes": _H + " SELECT query_id, chunk_id, string_agg(DISTINCT lane, ',' ORDER BY lane) AS lanes FROM (SELECT query_id, chunk_id, 'text' AS lane FROM hits UNION ALL SELECT DISTINCT 'q1', chunk_id, 'path' FROM c WHERE contains(lower(path), 'catalog')) GROUP BY 1, 2",
    "suffix_matched_ranks": _H + f""", t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_ORD}) AS rank FROM hits) WHERE rank <= 10), w AS (SELECT DISTINCT '/' || split_part(path, '/', -1) AS tail FROM c WHERE path LIKE '%.md')
SELECT query_id, min(rank) AS first_rank, count(DISTINCT path) AS n_paths FROM t WHERE query_id IN ('q1', 'q2') AND '/' || split_part(path, '/', -1) IN (SELECT tail FROM w) GROUP BY 1""",
    "promotion_gate": _GR + """, m AS (SELECT round(avg(CASE WHEN first_rank <= 3 THEN 1.0 ELSE 0 END), 6) AS r3, round(avg(CASE WHEN first_rank <= 3 THEN 1.0 / first_rank ELSE 0 END), 6) AS m3, round(avg(CASE WHEN first_rank <= 10 THEN 1.0 ELSE 0 END), 6) AS r10, round(avg(CASE WHEN first_rank <= 10 THEN 1.0 / first_rank ELSE 0 END), 6) AS m10 FROM ranks),
x AS (SELECT 'recall' AS metric, r3 AS base, r10 AS candidate FROM m UNION ALL SELECT 'mrr', m3, m10 FROM m) SELECT *, candidate >= base AS held, bool_and(candidate >= base) OVER () AS promoted FROM x""",
}
