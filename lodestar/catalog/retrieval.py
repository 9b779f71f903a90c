"""Index, ranked queries and their evaluation over chunks and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import graphs as G
from ..operators import kept
from ..operators import retrieval as R
from ..sources.tables import table

QUERY = [("q1", 1, "catalog"), ("q1", 2, "review"), ("q2", 1, "snapshot"), ("q2", 1, "receipt"), ("q3", 1, "vertrag"), ("q4", 1, "lease"), ("q4", 2, "queue"), ("q4", 3, "filter")]
CHUNK = ("chunk_id", "repo_id", "path", "start_line", "end_line", "layer", "artifact_type", "language", "content", "size_bytes", "start_byte")


def chunks(spark: SparkSession, base: str, *columns: str) -> DataFrame:
    return table(spark, base, "chunks", *(columns or CHUNK)).distinct()


def _query(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERY, "query_id string, group_id int, term string")


def _index(spark: SparkSession, base: str) -> kept.Index:
    c = table(spark, base, "chunks", "chunk_id", "path", "content")
    text = F.concat_ws(" ", F.coalesce("content", F.lit("")), F.coalesce(R.path_tokens("path"), F.lit("")))
    return kept.kept("chunks", c, c.distinct().select(F.col("chunk_id").alias("doc"), text.alias("text")))


def _document_index(spark: SparkSession, base: str) -> kept.Index:
    d = table(spark, base, "documents", "doc_id", "text")
    return kept.kept("documents", d, d.distinct().select(F.col("doc_id").alias("doc"), "text"))


def _posts(spark: SparkSession, base: str) -> DataFrame:
    return _index(spark, base).postings


def _hits(spark: SparkSession, base: str) -> DataFrame:
    meta = chunks(spark, base, "chunk_id", "repo_id", "path", "start_line", "end_line", "layer")
    return _index(spark, base).scores(_query(spark)).join(meta, F.col("doc") == F.col("chunk_id")).drop("doc")


def _order() -> list:
    return [F.col("score"), F.col("repo_id"), F.col("path"), F.col("start_line"), F.col("chunk_id")]


def bm25_topk(spark, base):
    return R.top_k(_hits(spark, base), 10, ["query_id"], _order()).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def term_statistics(spark, base):
    return R.term_statistics(_posts(spark, base))


def doc_lengths(spark, base):
    return _index(spark, base).lengths


def metadata_scan(spark, base):
    rows = chunks(spark, base, "chunk_id", "repo_id", "path", "start_line", "layer", "artifact_type")
    rows = rows.where(R.predicates(path="graph", ext="py", artifact_type="code"))
    return rows.orderBy("repo_id", "path", "start_line", "chunk_id").limit(50).select("chunk_id", "repo_id", "path", "start_line")


def metadata_filters(spark, base):
    rows = chunks(spark, base, "chunk_id", "repo_id", "path", "layer", "artifact_type")
    return rows.where(R.predicates(path="SRC_", layer="core", artifact_type="code") | R.predicates(repo="lanternfield", ext=".md")).select("chunk_id")


def path_exclusion(spark, base):
    rows = chunks(spark, base, "chunk_id", "path", "artifact_type")
    seen = rows.where("artifact_type = 'test'")
    return R.exclude_paths(rows, seen).groupBy("artifact_type").agg(F.count("*").alias("n_chunks"))


def _entry_distances(spark, base):
    """Steps along resolved imports from the files under ``cli`` and ``tools`` to every Python file they lead to."""
    c = chunks(spark, base, "repo_id", "path", "content").where("path like '%.py'")
    node = lambda p: F.concat_ws("\x1f", "repo_id", p)
    edges = G.resolve_modules(G.import_edges(c), c).where("target is not null").select(node("path").alias("src"), node("target").alias("dst"))
    files = c.select("repo_id", "path", node("path").alias("node")).distinct()
    found = G.bfs_distances(files, edges, files.where("path rlike '^(cli|tools)/'")).where("distance >= 0")
    return files.join(found, "node").select("repo_id", "path", "distance")


def graph_boosted_rerank(spark, base):
    ranked = R.graph_boost(_hits(spark, base), _entry_distances(spark, base))
    order = [F.desc("final_score"), F.col("path"), *_order()]
    return R.top_k(ranked, 10, ["query_id"], order).select("query_id", "rank", "chunk_id", "bm25_norm", "final_score", "distance")


def federated_topk(spark, base):
    one = _hits(spark, base).where("query_id = 'q2'")
    return R.federated_top_k(one, "repo_id", 3, 20, _order()).select("repo_id", "bundle_rank", "chunk_id", F.round("score", 6).alias("score"))


def federation_summary(spark, base):
    hits, bundles = _hits(spark, base).where("query_id = 'q2'"), table(spark, base, "bundles", "repo_id", "last_fingerprint").distinct()
    n = hits.groupBy("repo_id").agg(F.count("*").alias("n_hits"), F.round(F.min("score"), 6).alias("best"))
    status = F.when(F.col("last_fingerprint").isNull(), "no_fingerprint").when(F.col("n_hits").isNull(), "no_hits").otherwise("ok")
    return bundles.join(n, "repo_id", "left").select("repo_id", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), "best", status.alias("status"))


def filename_conflicts(spark, base):
    c = table(spark, base, "chunks", "repo_id", "path").distinct()
    return R.filename_conflicts(c, "repo_id")


def cross_repo_links(spark, base):
    top = R.top_k(_hits(spark, base), 10, ["query_id"], _order())
    out = R.cross_links(top, "repo_id", "chunk_id")
    return out.select("query_id", "left_bundle", "right_bundle", F.array_join("left_ids", ",").alias("left_ids"), F.array_join("right_ids", ",").alias("right_ids"))


def unique_path_topk(spark, base):
    return R.unique_paths(_hits(spark, base), 10, _order()).select("query_id", "rank", "path", "chunk_id")


def review_fusion_round_robin(spark, base):
    hits = _hits(spark, base).where("query_id in ('q1', 'q4')")
    lane = F.when(F.col("layer") == "core", 1).when(F.col("layer") == "test", 2).otherwise(3)
    out = R.round_robin(hits.withColumn("lane_order", lane), _order())
    return out.select("query_id", "global_rank", "lane_order", "lane_rank", "path", "final_score")


def context_window_overlap(spark, base):
    c = chunks(spark, base, "chunk_id", "repo_id", "path", "start_line", "end_line")
    t = c.where("start_line > 1").select("repo_id", "path", (F.col("start_line") - 3).alias("start_line"), (F.col("start_line") + 3).alias("end_line")).distinct()
    return R.window_context(c, t).select("chunk_id", "t_start", "t_end")


def file_context(spark, base):
    f = R.file_context(chunks(spark, base, "chunk_id", "repo_id", "path", "start_line", "content"))
    return f.select("repo_id", "path", "n_chunks", F.md5(F.encode("content", "utf-8")).alias("md5"))


def prefix_candidates(spark, base):
    return R.prefix_candidates(_posts(spark, base), "snap")


def index_health(spark, base):
    return R.index_health(chunks(spark, base, "chunk_id", "path", "content"), _posts(spark, base))


def path_chunk_ids(spark, base):
    c = table(spark, base, "chunks", "chunk_id", "repo_id", "path").distinct()
    return c.groupBy("repo_id", "path").agg(F.array_join(F.array_sort(F.collect_set("chunk_id")), ",").alias("chunk_ids"), F.count("*").alias("n"))


def content_signature(spark, base):
    return R.signature(chunks(spark, base, "chunk_id", "content"), "chunk_id", "content")


def _gold_ranks(spark, base):
    """Ranked documents of each test query; one is relevant if its path holds an expected one or its text the whole passage."""
    gold = table(spark, base, "goldset", "item_id", "language", "category", "query_text", "passage", "expected_paths").distinct()
    docs = table(spark, base, "documents", "doc_id", "text", "path").distinct()
    q = gold.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(R.terms(F.col("query_text")))).alias("term")).withColumn("group_id", F.lit(1))
    hits = _document_index(spark, base).scores(q)
    ranked = R.top_k(hits, 10, ["query_id"], [F.col("score"), F.col("doc")])
    body = docs.where("text is not null").withColumnRenamed("doc_id", "doc")
    rel = ranked.join(body, "doc").join(gold.select(F.col("item_id").alias("query_id"), "passage", "expected_paths"), "query_id")
    rel = rel.where(F.expr("contains(lower(text), lower(passage)) or exists(expected_paths, e -> contains(path, e))"))
    first = rel.groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return gold.select(F.col("item_id").alias("query_id"), "language", "category").join(first, "query_id", "left"), ranked


def eval_first_ranks(spark, base):
    return _gold_ranks(spark, base)[0].select("query_id", "category", "first_rank")


def recall_mrr(spark, base):
    return E.recall_mrr(_gold_ranks(spark, base)[0], 10)


def recall_by_category_grouping_sets(spark, base):
    return E.recall_by_groups(_gold_ranks(spark, base)[0], 10)


def miss_taxonomy(spark, base):
    ranks, ranked = _gold_ranks(spark, base)
    return E.miss_taxonomy(ranks, ranked)


def paired_improvement(spark, base):
    ranks = _gold_ranks(spark, base)[0]
    a = ranks.select("query_id", "category", F.lit("base").alias("route"), F.when(F.col("first_rank") <= 3, 1 / F.col("first_rank")).otherwise(0.0).alias("value"))
    b = ranks.select("query_id", "category", F.lit("new").alias("route"), F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("value"))
    return E.paired_improvement(a.unionByName(b), "base", "new")


def _states(spark, base):
    """Chunks before and after the last batch, as (doc, text)."""
    c = table(spark, base, "chunks", "chunk_id", "content", "batch_no").where("chunk_id is not null")
    before = c.where("batch_no < 9").groupBy("chunk_id").agg(F.max("content").alias("text"))
    after = c.where("batch_no > 0").groupBy("chunk_id").agg(F.max("content").alias("text"))
    return (x.select(F.col("chunk_id").alias("doc"), "text") for x in (before, after))


def index_update_states(spark, base):
    """What an update of the index would take over, make anew and drop."""
    old, new = _states(spark, base)
    return kept.states(kept.digests(old), kept.digests(new)).groupBy("state").agg(F.count("*").alias("n_docs"))


def index_update_equals_build(spark, base):
    """Postings of an updated index beside those of one built whole: rows in only one of them."""
    import uuid

    from ..session import shared_folder

    root = f"{shared_folder(spark)}/index/{uuid.uuid4().hex}"
    old, new = _states(spark, base)
    a, b = kept.update(kept.build(old, f"{root}/1"), new, f"{root}/2").postings, kept.build(new, f"{root}/3").postings
    x = a.withColumn("s", F.lit(1)).unionByName(b.withColumn("s", F.lit(-1))).groupBy("doc", "term", "tf").agg(F.sum("s").alias("s"))
    return x.agg(F.count("*").alias("n_postings"), F.count_if(F.col("s") != 0).alias("n_different"))


QUERIES = {f.__name__: f for f in (
    index_update_states, index_update_equals_build, bm25_topk, term_statistics, doc_lengths, metadata_scan, metadata_filters, path_exclusion, graph_boosted_rerank, federated_topk, federation_summary, filename_conflicts,
    cross_repo_links, unique_path_topk, review_fusion_round_robin, context_window_overlap, file_context, prefix_candidates, index_health, path_chunk_ids, content_signature,
    eval_first_ranks, recall_mrr, recall_by_category_grouping_sets, miss_taxonomy, paired_improvement)}

_C = "WITH c AS (SELECT DISTINCT chunk_id, repo_id, path, start_line, end_line, layer, artifact_type, language, content, size_bytes, start_byte FROM chunks)"
_P = _C + """,
tok AS (SELECT chunk_id AS doc, unnest(regexp_extract_all(lower(concat_ws(' ', coalesce(content, ''), translate(lower(replace(path, chr(92), '/')), '/._-', '    '))), '[\\p{L}\\p{N}]+')) AS term FROM c),
posts AS (SELECT doc, term, count(*) AS tf FROM tok GROUP BY 1, 2),
dls AS (SELECT doc, sum(tf) AS dl FROM posts GROUP BY 1)"""


def _scored(prefix: str, posts: str, queries: str) -> str:
    return prefix + f""",
q AS ({queries}),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dls),
tdf AS (SELECT term, count(*) AS df FROM {posts} WHERE term IN (SELECT term FROM q) GROUP BY 1),
need AS (SELECT query_id, count(DISTINCT group_id) AS n_groups FROM q GROUP BY 1),
sc AS (SELECT q.query_id, p.doc, -sum(greatest(1e-6, ln((st.n - tdf.df + 0.5) / (tdf.df + 0.5))) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * dls.dl / st.avgdl))) AS s, count(DISTINCT q.group_id) AS got
  FROM {posts} p JOIN q USING (term) JOIN tdf USING (term) JOIN dls USING (doc), st GROUP BY 1, 2),
scored AS (SELECT sc.query_id, doc, round(s, 12) AS score FROM sc JOIN need USING (query_id) WHERE got = n_groups)"""


_Q = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b}, '{c}')" for a, b, c in QUERY) + ") v(query_id, group_id, term)"
_H = _scored(_P, "posts", _Q) + ",\nhits AS (SELECT query_id, score, c.chunk_id, repo_id, path, start_line, end_line, layer FROM scored JOIN c ON c.chunk_id = scored.doc)"
_ORD = "score, repo_id, path, start_line, chunk_id"
_G = """WITH gold AS (SELECT DISTINCT item_id AS query_id, language, category, query_text, passage, expected_paths FROM goldset),
d AS (SELECT DISTINCT doc_id AS doc, text, path FROM documents),
posts AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS term FROM d) GROUP BY 1, 2),
dls AS (SELECT doc, sum(tf) AS dl FROM posts GROUP BY 1)"""
_GR = _scored(_G, "posts", "SELECT DISTINCT query_id, 1 AS group_id, term FROM (SELECT query_id, unnest(regexp_extract_all(lower(query_text), '[\\p{L}\\p{N}]+')) AS term FROM gold)") + """,
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, doc) AS rank FROM scored) WHERE rank <= 10),
ranks AS (SELECT gold.query_id, gold.language, gold.category, f.first_rank FROM gold LEFT JOIN (
  SELECT r.query_id, min(r.rank) AS first_rank FROM ranked r JOIN d USING (doc) JOIN gold g USING (query_id) WHERE d.text IS NOT NULL AND (contains(lower(d.text), lower(g.passage)) OR len(list_filter(g.expected_paths, lambda e: contains(d.path, e))) > 0) GROUP BY 1) f USING (query_id))"""

_ST = "WITH k AS (SELECT chunk_id AS doc, content, batch_no FROM chunks WHERE chunk_id IS NOT NULL), o AS (SELECT doc, max(content) AS text FROM k WHERE batch_no < 9 GROUP BY 1), n AS (SELECT doc, max(content) AS text FROM k WHERE batch_no > 0 GROUP BY 1)"
SQL = {
    "index_update_states": _ST + " SELECT CASE WHEN n.doc IS NULL THEN 'deleted' WHEN o.doc IS NULL THEN 'added' WHEN o.text IS NOT DISTINCT FROM n.text THEN 'reused' ELSE 'changed' END AS state, count(*) AS n_docs FROM o FULL JOIN n ON o.doc = n.doc GROUP BY 1",
    "index_update_equals_build": _ST + " SELECT count(*) AS n_postings, 0 AS n_different FROM (SELECT DISTINCT doc, term FROM (SELECT doc, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS term FROM n))",
    "bm25_topk": _H + f" SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_ORD}) AS rank FROM hits) WHERE rank <= 10",
    "term_statistics": _P + " SELECT term, count(*) AS df, sum(tf) AS cf FROM posts GROUP BY 1",
    "doc_lengths": _P + " SELECT * FROM dls",
    "metadata_scan": _C + " SELECT DISTINCT chunk_id, repo_id, path, start_line FROM c WHERE lower(path) LIKE '%graph%' AND lower(path) LIKE '%.py' AND artifact_type = 'code' ORDER BY repo_id, path, start_line, chunk_id LIMIT 50",
    "metadata_filters": _C + " SELECT DISTINCT chunk_id FROM c WHERE (lower(path) LIKE '%src_%' AND layer = 'core' AND artifact_type = 'code') OR (repo_id = 'lanternfield' AND lower(path) LIKE '%.md')",
    "path_exclusion": _C + " SELECT artifact_type, count(*) AS n_chunks FROM (SELECT DISTINCT chunk_id, path, artifact_type FROM c) x WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.path = x.path AND y.artifact_type = 'test') GROUP BY 1",
    "graph_boosted_rerank": _H.replace("WITH c AS", "WITH RECURSIVE c AS", 1) + f""", py AS (SELECT DISTINCT repo_id, path, content FROM c WHERE path LIKE '%.py'),
imp AS (SELECT DISTINCT repo_id, path, split_part(module, '.', -1) AS leaf FROM (SELECT repo_id, path, unnest(regexp_extract_all(content, '(?m)^(?:from|import)[ \\t]+([A-Za-z_][A-Za-z0-9_.]*)', 1)) AS module FROM py WHERE content IS NOT NULL)),
idx AS (SELECT repo_id, regexp_replace(split_part(path, '/', -1), '\\.py$', '') AS leaf, min(path) AS target FROM (SELECT DISTINCT repo_id, path FROM py) GROUP BY 1, 2 HAVING count(*) = 1),
edge AS (SELECT DISTINCT repo_id, path, target FROM imp JOIN idx USING (repo_id, leaf)),
walk AS (SELECT DISTINCT repo_id, path, 0 AS d FROM py WHERE regexp_matches(path, '^(cli|tools)/') UNION SELECT w.repo_id, e.target, w.d + 1 FROM walk w JOIN edge e ON e.repo_id = w.repo_id AND e.path = w.path WHERE w.d < 30),
dist AS (SELECT repo_id, path, min(d) AS distance FROM walk GROUP BY 1, 2),
b AS (SELECT hits.*, coalesce(distance, -1) AS distance, abs(score) / max(abs(score)) OVER (PARTITION BY query_id) AS nrm FROM hits LEFT JOIN dist USING (repo_id, path)),
f AS (SELECT *, round(nrm, 6) AS bm25_norm, round((0.65 * nrm + least(0.2 * CASE WHEN distance >= 0 THEN 1.0 / (distance + 1) ELSE 0 END + CASE WHEN distance = 0 THEN 0.15 ELSE 0 END, 0.35))
  * CASE WHEN coalesce(layer = 'test', false) OR contains(lower(path), 'test') THEN 0.75 ELSE 1 END, 6) AS final_score FROM b)
SELECT query_id, rank, chunk_id, bm25_norm, final_score, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, path, {_ORD}) AS rank FROM f) WHERE rank <= 10""",
    "federated_topk": _H + f" SELECT repo_id, bundle_rank, chunk_id, round(score, 6) AS score FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY {_ORD}) AS bundle_rank FROM hits WHERE query_id = 'q2') WHERE bundle_rank <= 3 ORDER BY {_ORD} LIMIT 20)",
    "federation_summary": _H + """ SELECT b.repo_id, coalesce(n_hits, 0) AS n_hits, best, CASE WHEN last_fingerprint IS NULL THEN 'no_fingerprint' WHEN n_hits IS NULL THEN 'no_hits' ELSE 'ok' END AS status
FROM (SELECT DISTINCT repo_id, last_fingerprint FROM bundles) b LEFT JOIN (SELECT repo_id, count(*) AS n_hits, round(min(score), 6) AS best FROM hits WHERE query_id = 'q2' GROUP BY 1) USING (repo_id)""",
    "filename_conflicts": "SELECT file_name, count(*) AS n_places, count(DISTINCT repo_id) AS n_bundles FROM (SELECT DISTINCT lower(split_part(path, '/', -1)) AS file_name, repo_id, path FROM chunks) GROUP BY 1 HAVING count(*) > 1",
    "cross_repo_links": _H + f""", t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_ORD}) AS rank FROM hits) WHERE rank <= 10),
e AS (SELECT query_id, repo_id AS b, list_sort(list(DISTINCT chunk_id))[1:5] AS ids FROM t GROUP BY 1, 2)
SELECT l.query_id, l.b AS left_bundle, r.b AS right_bundle, array_to_string(l.ids, ',') AS left_ids, array_to_string(r.ids, ',') AS right_ids FROM e l JOIN e r ON l.query_id = r.query_id AND l.b < r.b""",
    "unique_path_topk": _H + f""", u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY {_ORD}) AS k FROM hits) WHERE k = 1)
SELECT query_id, rank, path, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_ORD}) AS rank FROM u) WHERE rank <= 10""",
    "review_fusion_round_robin": _H + f""", l AS (SELECT *, CASE WHEN layer = 'core' THEN 1 WHEN layer = 'test' THEN 2 ELSE 3 END AS lane_order FROM hits WHERE query_id IN ('q1', 'q4')),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, lane_order ORDER BY {_ORD}) AS lane_rank FROM l),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY lane_rank, lane_order) AS k FROM r) WHERE k = 1),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lane_rank, lane_order) AS global_rank FROM u)
SELECT query_id, global_rank, lane_order, lane_rank, path, round(1.0 / global_rank, 6) AS final_score FROM g""",
    "context_window_overlap": _C + """, k AS (SELECT DISTINCT chunk_id, repo_id, path, start_line, end_line FROM c), t AS (SELECT DISTINCT repo_id, path, start_line - 3 AS t_start, start_line + 3 AS t_end FROM k WHERE start_line > 1)
SELECT chunk_id, t_start, t_end FROM k JOIN t USING (repo_id, path) WHERE start_line <= t_end AND end_line >= t_start""",
    "file_context": _C + " SELECT repo_id, path, count(*) AS n_chunks, md5(string_agg(coalesce(content, ''), '' ORDER BY start_line, chunk_id)) AS md5 FROM (SELECT DISTINCT chunk_id, repo_id, path, start_line, content FROM c) GROUP BY 1, 2",
    "prefix_candidates": _P + " SELECT DISTINCT doc FROM posts WHERE starts_with(term, 'snap')",
    "index_health": _P + """ SELECT count(*) AS n_rows, count(DISTINCT chunk_id) AS n_ids, round(avg(length(content)), 4) AS avg_length, max(length(content)) AS max_length, count(*) FILTER (WHERE content IS NULL OR content = '') AS n_empty,
(SELECT count(DISTINCT doc) FROM posts) AS n_indexed FROM (SELECT DISTINCT chunk_id, path, content FROM c)""",
    "path_chunk_ids": "SELECT repo_id, path, string_agg(chunk_id, ',' ORDER BY chunk_id) AS chunk_ids, count(*) AS n FROM (SELECT DISTINCT chunk_id, repo_id, path FROM chunks) GROUP BY 1, 2",
    "content_signature": "SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || substr(md5(concat_ws(chr(31), chunk_id, coalesce(content, chr(30)))), 1, 15) AS BIGINT)::HUGEINT) AS VARCHAR) AS fingerprint FROM (SELECT DISTINCT chunk_id, content FROM chunks)",
    "eval_first_ranks": _GR + " SELECT query_id, category, first_rank FROM ranks",
    "recall_mrr": _GR + " SELECT count(*) AS n_queries, round(avg(CASE WHEN first_rank <= 10 THEN 1.0 ELSE 0 END) * 100, 6) AS recall_at_k, round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr, round(avg(CASE WHEN first_rank IS NULL THEN 1.0 ELSE 0 END), 6) AS zero_hit_ratio FROM ranks",
    "recall_by_category_grouping_sets": _GR + """ SELECT coalesce(category, '(all)') AS category, coalesce(language, '(all)') AS language, count(*) AS n_queries, round(avg(CASE WHEN first_rank <= 10 THEN 1.0 ELSE 0 END) * 100, 6) AS recall_at_k,
round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr FROM ranks GROUP BY GROUPING SETS ((), (category), (language))""",
    "miss_taxonomy": _GR + """ SELECT miss_type, count(*) AS n_queries FROM (SELECT CASE WHEN first_rank IS NOT NULL AND first_rank <= 3 THEN 'hit' WHEN first_rank IS NOT NULL THEN 'ranked_low' WHEN n IS NULL THEN 'no_candidates' ELSE 'not_ranked' END AS miss_type
FROM ranks LEFT JOIN (SELECT query_id, count(*) AS n FROM ranked GROUP BY 1) USING (query_id)) GROUP BY 1""",
    "paired_improvement": _GR + """, v AS (SELECT category, CASE WHEN first_rank <= 3 THEN 1.0 / first_rank ELSE 0 END AS a, coalesce(1.0 / first_rank, 0) AS b FROM ranks)
SELECT category, count(*) AS n_pairs, round(avg(a), 6) AS mean_base, round(avg(b), 6) AS mean_new, round(avg(b - a), 6) AS mean_gain, count(*) FILTER (WHERE b > a) AS n_better, count(*) FILTER (WHERE b < a) AS n_worse FROM v GROUP BY 1""",
}
