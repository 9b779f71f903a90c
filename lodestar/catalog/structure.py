"""Graphs, ranges, texts, vectors, budgets and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normal
from ..operators import evaluation as E
from ..operators import graphs as G
from ..operators import kept
from ..operators import ranges as N
from ..operators import selection as S
from ..operators import texts as T
from ..operators import vectors as V
from ..operators.retrieval import row_sum
from ..sources.tables import table
from .retrieval import chunks


def _delta_graph(spark, base):
    nodes = table(spark, base, "snapshots", "snapshot_id").select(normal.key("snapshot_id").alias("node")).distinct()
    d = table(spark, base, "deltas", "from_snapshot_id", "to_snapshot_id").select(normal.key("from_snapshot_id").alias("src"), normal.key("to_snapshot_id").alias("dst")).where("src is not null and dst is not null").distinct()
    roots = nodes.join(d.select(F.col("dst").alias("node")), "node", "left_anti")
    return nodes, d, roots


def bfs_distance(spark, base):
    return G.bfs_distances(*_delta_graph(spark, base))


def reachability_counts(spark, base):
    d = bfs_distance(spark, base)
    return d.agg(F.count_if(F.col("distance") >= 0).alias("reachable"), F.count_if(F.col("distance") < 0).alias("unreachable"), F.max("distance").alias("deepest"))


def edge_counts(spark, base):
    edges = G.import_edges(chunks(spark, base, "repo_id", "path", "content"))
    return edges.groupBy("repo_id").agg(F.count("*").alias("n_edges"), F.count_distinct("path").alias("n_sources"), F.count_distinct("module").alias("n_modules"))


def module_resolution(spark, base):
    c = chunks(spark, base, "repo_id", "path", "content")
    return G.resolve_modules(G.import_edges(c), c).select("repo_id", "path", "module", "resolution", "target")


def _calls(spark, base):
    """Call sites and definitions, extracted once per state of the chunks."""
    c = table(spark, base, "chunks", "repo_id", "path", "chunk_id", "content")
    calls = kept.kept_table("call-sites", c, lambda: G.call_sites(c.distinct()))
    return calls, kept.kept_table("definitions", c, lambda: G.definitions(c.distinct()))


def symbol_definitions(spark, base):
    return _calls(spark, base)[1].select("repo_id", "path", "chunk_id", "name")


def call_resolution(spark, base):
    calls, defs = _calls(spark, base)
    return G.resolve_calls(calls, defs).groupBy("status").agg(F.count("*").alias("n_calls"), F.sum("n").alias("n_sites"))


def callers(spark, base):
    calls, defs = _calls(spark, base)
    return G.callers(calls, defs)


def callees(spark, base):
    calls, defs = _calls(spark, base)
    return G.callees(calls, defs)


def references(spark, base):
    calls, _ = _calls(spark, base)
    return calls.where("callee in ('max', 'open', 'len')").select("callee", "path", "chunk_id", "n")


def python_symbols(spark, base):
    from ..operators.retrieval import file_context

    return G.python_symbols(file_context(chunks(spark, base, "chunk_id", "repo_id", "path", "start_line", "content")))


def range_overlap_join(spark, base):
    c = chunks(spark, base, "chunk_id", "repo_id", "path", "start_line", "end_line")
    a = c.select("repo_id", "path", F.col("chunk_id").alias("a_id"), F.col("start_line").alias("a_start"), F.col("end_line").alias("a_end"))
    b = c.where("start_line = 1").select("repo_id", "path", F.col("chunk_id").alias("b_id"), F.lit(10).cast("bigint").alias("b_start"), F.lit(40).cast("bigint").alias("b_end"))
    return N.overlap_join(a, b, ["repo_id", "path"]).select("a_id", "b_id")


def interval_union_coverage(spark, base):
    c = chunks(spark, base, "repo_id", "path", "start_line", "end_line")
    t = c.where("start_line > 1").select("repo_id", "path", (F.col("start_line") - 10).alias("a_start"), (F.col("start_line") + 10).alias("a_end"))
    cited = c.select("repo_id", "path", F.col("start_line").alias("b_start"), (F.col("start_line") + 6).alias("b_end"))
    return N.coverage(t, cited, ["repo_id", "path"])


def interval_islands(spark, base):
    c = chunks(spark, base, "repo_id", "path", "start_line", "end_line")
    return N.islands(c, ["repo_id", "path"], "start_line", "end_line").select("repo_id", "path", "start", "end")


def byte_to_line(spark, base):
    c = chunks(spark, base, "chunk_id", "content").where("content is not null")
    return c.select("chunk_id", N.line_of_byte(F.col("content"), F.lit(200)).alias("line"))


def content_verification(spark, base):
    c = table(spark, base, "chunks", "chunk_id", "content", "content_sha256", "size_bytes").distinct()
    return N.verify_content(c).groupBy("content_status", "size_status").agg(F.count("*").alias("n"))


def chunk_pack(spark, base):
    return N.pack_lines(table(spark, base, "documents", "doc_id", "text").distinct(), "doc_id", "text", 600, 8)


def chunk_ids(spark, base):
    return N.chunk_ids(chunks(spark, base, "chunk_id", "path", "start_line", "content"))


def chunk_offsets(spark, base):
    c = chunks(spark, base, "chunk_id", "repo_id", "path", "start_line", "content").where("content is not null")
    return N.cumulative_offsets(c).select("chunk_id", "offset")


def redact_secrets(spark, base):
    c = chunks(spark, base, "chunk_id", "content").where("content is not null").withColumn("clean", T.redact(F.col("content")))
    return c.where("clean <> content").select("chunk_id", F.md5(F.encode("clean", "utf-8")).alias("md5"))


def content_first_match_snippet(spark, base):
    d = table(spark, base, "documents", "doc_id", "text").distinct().withColumn("snippet", T.first_match(F.col("text"), "snapshot"))
    return d.where("snippet is not null").select("doc_id", "snippet")


def retrieval_metadata(spark, base):
    return T.source_metadata(chunks(spark, base, "chunk_id", "content"))


def classify_paths(spark, base):
    p = chunks(spark, base, "repo_id", "path").withColumns(T.path_class())
    return p.select("repo_id", "path", "category", "tags", "ext")


def facet_counts(spark, base):
    p = chunks(spark, base, "repo_id", "path").withColumns(T.path_class())
    return p.groupBy("repo_id", "category").agg(F.count("*").alias("n_files"), F.count_distinct("ext").alias("n_ext"))


def repo_summary(spark, base):
    c = chunks(spark, base, "repo_id", "path", "chunk_id", "content").withColumns(T.path_class())
    per = c.groupBy("repo_id", "path", "category").agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"))
    return per.groupBy("repo_id").agg(F.count("*").alias("total"), F.count_if(F.col("category").isin("source", "doc", "config", "test", "contract")).alias("text_files"), F.sum("bytes").alias("bytes"))


def token_estimates(spark, base):
    c = chunks(spark, base, "chunk_id", "repo_id", "size_bytes")
    return c.groupBy("repo_id").agg(F.sum(F.ceil(F.coalesce("size_bytes", F.lit(0)) / 4)).alias("est_tokens"), F.count("*").alias("n_chunks"))


def cosine_topk(spark, base):
    e = table(spark, base, "embeddings", "vec_id", "embedding")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return V.cosine_top_k(q, e.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("v")), 10)


def context_first_fit(spark, base):
    c = chunks(spark, base, "repo_id", "chunk_id", "layer", "size_bytes").where("repo_id is not null")
    c = c.select("repo_id", F.when(F.col("layer") == "core", 1).otherwise(2).alias("priority"), F.ceil(F.coalesce("size_bytes", F.lit(400)) / 4).cast("long").alias("tokens"), F.col("chunk_id").alias("id"))
    return S.first_fit(c, "repo_id", 3000).select("repo_id", "pos", "id", "used")


def context_weighted_greedy(spark, base):
    c = chunks(spark, base, "repo_id", "chunk_id", "path", "size_bytes").where("size_bytes is not null")
    rel = F.pmod(F.xxhash64("chunk_id"), F.lit(1000)) / 1000
    c = c.select("repo_id", F.col("chunk_id").alias("id"), F.col("path").alias("source"), rel.alias("relevance"), F.ceil(F.col("size_bytes") / 4).cast("long").alias("tokens"), F.col("size_bytes").alias("bytes"))
    return S.weighted_greedy(c, "repo_id", 2000, 9000)


def report_parts(spark, base):
    c = chunks(spark, base, "repo_id", "chunk_id", "size_bytes").withColumn("size_bytes", F.coalesce("size_bytes", F.lit(0)))
    return S.split_by_size(c, "repo_id", "chunk_id", "size_bytes", 5000).groupBy("repo_id", "part").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


def bounded_sources(spark, base):
    """Files of a repository in order while their bytes together stay under the bound."""
    c = chunks(spark, base, "repo_id", "path", "chunk_id", "content").groupBy("repo_id", "path").agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"))
    return S.running_before(c, "repo_id", ["path"], "bytes").withColumn("running", F.col("before") + F.col("bytes")).where("running <= 20000").select("repo_id", "path", "running")


def precision_recall_multiset(spark, base):
    """Stated first lines against those recomputed from the chunks before, as multisets."""
    c = chunks(spark, base, "chunk_id", "repo_id", "path", "start_line", "start_byte", "content").where("content is not null")
    actual = N.cumulative_offsets(c).select("repo_id", "path", F.col("offset").alias("at"))
    return E.multiset_match(actual, c.select("repo_id", "path", F.col("start_byte").alias("at")), "repo_id", "path", "at")


def p95_nearest_rank(spark, base):
    return E.nearest_rank(table(spark, base, "events", "event_type", "value"), "event_type", "value")


def tumbling_windows(spark, base):
    e = table(spark, base, "events", "ts", "event_type", "value")
    return e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def session_windows(spark, base):
    e = table(spark, base, "events", "ts", "user_id")
    return e.groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def incremental_reuse(spark, base):
    """Files of the last batch against all earlier ones: added, changed, reused by content digest."""
    c = table(spark, base, "chunks", "chunk_id", "repo_id", "path", "content", "batch_no").distinct()
    old = c.where("batch_no < 9").groupBy("repo_id", "path").agg(row_sum("chunk_id", "content").alias("a"))
    new = c.groupBy("repo_id", "path").agg(row_sum("chunk_id", "content").alias("b"))
    state = F.when(F.col("a").isNull(), "added").when(F.col("a") == F.col("b"), "reused").otherwise("changed")
    return new.join(old, ["repo_id", "path"], "left").groupBy(state.alias("state")).agg(F.count("*").alias("n_files"))


def churn(spark, base):
    """Batches that touched each file."""
    c = table(spark, base, "chunks", "repo_id", "path", "batch_no").distinct()
    return c.groupBy("repo_id", "path").agg(F.count_distinct("batch_no").alias("n_batches"))


QUERIES = {f.__name__: f for f in (bfs_distance, reachability_counts, edge_counts, module_resolution, symbol_definitions, call_resolution, callers, callees, references, python_symbols, range_overlap_join, interval_union_coverage,
    interval_islands, byte_to_line, content_verification, chunk_pack, chunk_ids, chunk_offsets, redact_secrets, content_first_match_snippet, retrieval_metadata, classify_paths, facet_counts, repo_summary, token_estimates, cosine_topk,
    context_first_fit, context_weighted_greedy, report_parts, bounded_sources, precision_recall_multiset, p95_nearest_rank, tumbling_windows, session_windows, incremental_reuse, churn)}

_BFS = """WITH RECURSIVE nodes AS (SELECT DISTINCT lower(trim(snapshot_id)) AS node FROM snapshots),
edges AS (SELECT DISTINCT lower(trim(from_snapshot_id)) AS src, lower(trim(to_snapshot_id)) AS dst FROM deltas WHERE from_snapshot_id IS NOT NULL AND to_snapshot_id IS NOT NULL),
walk AS (SELECT node, 0 AS d FROM nodes WHERE node NOT IN (SELECT dst FROM edges) UNION SELECT e.dst, w.d + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.d < 200),
dist AS (SELECT n.node, coalesce(min(w.d), -1) AS distance FROM nodes n LEFT JOIN walk w USING (node) GROUP BY 1)"""
_C = "WITH c AS (SELECT DISTINCT chunk_id, repo_id, path, start_line, end_line, start_byte, layer, size_bytes, content FROM chunks), py AS (SELECT * FROM c WHERE path LIKE '%.py' AND content IS NOT NULL)"
_IMP = _C + ", imp AS (SELECT DISTINCT repo_id, path, unnest(regexp_extract_all(content, '(?m)^(?:from|import)[ \\t]+([A-Za-z_][A-Za-z0-9_.]*)', 1)) AS module FROM py)"
_CALL = _C + """, defs AS (SELECT DISTINCT repo_id, path, chunk_id, unnest(regexp_extract_all(content, '(?m)^[ \\t]*(?:async[ \\t]+)?def[ \\t]+([A-Za-z_][A-Za-z0-9_]*)', 1)) AS name FROM py),
calls AS (SELECT repo_id, path, chunk_id, callee, count(*) AS n FROM (SELECT repo_id, path, chunk_id, unnest(regexp_extract_all(content, '(?:^|[^A-Za-z0-9_.])([A-Za-z_][A-Za-z0-9_]*)\\(', 1)) AS callee FROM py) GROUP BY 1, 2, 3, 4)"""


def _isl(table_: str, keys: str, s: str, e: str) -> str:
    return f"""(SELECT {keys}, min({s}) AS start, max({e}) AS "end" FROM (SELECT *, sum(nw) OVER (PARTITION BY {keys} ORDER BY {s}, {e} ROWS UNBOUNDED PRECEDING) AS isl FROM (
SELECT *, CASE WHEN top IS NULL OR {s} > top + 1 THEN 1 ELSE 0 END AS nw FROM (SELECT *, max({e}) OVER (PARTITION BY {keys} ORDER BY {s}, {e} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM {table_}))) GROUP BY {keys}, isl)"""


def _rx() -> str:
    """The redaction chain in SQL; patterns with a back-reference as one pattern per thing referred to."""
    expr = "content"
    for pattern, left in T.REDACTIONS:
        ways = [pattern]
        if "\\3" in pattern:
            ways = [pattern.replace("(['\\\"])", f"({q})", 1).replace("\\3", q) for q in "'\""]
        elif "\\1" in pattern:
            kinds = ["PRIVATE KEY", "RSA PRIVATE KEY", "EC PRIVATE KEY", "DSA PRIVATE KEY", "OPENSSH PRIVATE KEY", "PGP PRIVATE KEY BLOCK"]
            ways = [f"(?s)-----BEGIN {k}-----.*?-----END {k}-----" for k in kinds]
        for w in ways:
            w = w.replace("'", "''")
            expr = f"regexp_replace({expr}, '{w}', '{left.replace('$', chr(92))}', 'g')"
    return expr


_IN = lambda values: ", ".join(f"'{v}'" for v in values)
_CLASS = _C + f""", p0 AS (SELECT DISTINCT repo_id, path, string_split(path, '/') AS parts, lower(split_part(path, '/', -1)) AS name, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS ext FROM c),
p AS (SELECT *, list_has_any(parts, ['config', '.github', '.wgx']) OR name IN ({_IN(T.CONFIG_NAMES)}) OR ext IN ({_IN(T.CONFIG_EXTENSIONS)}) AS conf FROM p0),
cls AS (SELECT repo_id, path, ext, CASE WHEN conf AND list_contains(parts, 'contracts') THEN 'contract' WHEN conf THEN 'config' WHEN ext IN ({_IN(T.DOC_EXTENSIONS)}) OR list_contains(parts, 'docs') THEN 'doc'
  WHEN list_contains(parts, 'contracts') THEN 'contract' WHEN list_has_any(parts, ['tests', 'test']) OR name LIKE '%\\_test.py' ESCAPE '\\' OR name LIKE 'test\\_%' ESCAPE '\\' THEN 'test'
  WHEN ext IN ({_IN(T.SOURCE_EXTENSIONS)}) OR list_has_any(parts, ['src', 'crates', 'scripts']) THEN 'source' ELSE 'other' END AS category,
  array_to_string(list_filter([CASE WHEN name LIKE '%.ai-context.yml' THEN 'ai-context' END, CASE WHEN list_contains(parts, '.github') AND list_contains(parts, 'workflows') AND ext IN ('.yml', '.yaml') THEN 'ci' END,
  CASE WHEN list_contains(parts, 'docs') AND list_contains(parts, 'adr') AND ext = '.md' THEN 'adr' END, CASE WHEN starts_with(name, 'runbook') AND ext = '.md' THEN 'runbook' END,
  CASE WHEN list_has_any(parts, ['scripts', 'bin']) AND ext IN ('.sh', '.py') THEN 'script' END, CASE WHEN list_contains(parts, 'export') AND ext = '.jsonl' THEN 'feed' END,
  CASE WHEN contains(name, 'lock') THEN 'lockfile' END, CASE WHEN name = 'readme.md' THEN 'ai-context' END, CASE WHEN list_contains(parts, '.wgx') AND starts_with(name, 'profile') THEN 'wgx-profile' END], lambda x: x IS NOT NULL), ',') AS tags FROM p)"""

SQL = {
    "bfs_distance": _BFS + " SELECT node, distance FROM dist",
    "reachability_counts": _BFS + " SELECT count(*) FILTER (WHERE distance >= 0) AS reachable, count(*) FILTER (WHERE distance < 0) AS unreachable, max(distance) AS deepest FROM dist",
    "edge_counts": _IMP + " SELECT repo_id, count(*) AS n_edges, count(DISTINCT path) AS n_sources, count(DISTINCT module) AS n_modules FROM imp GROUP BY 1",
    "module_resolution": _IMP + """, idx AS (SELECT repo_id, regexp_replace(split_part(path, '/', -1), '\\.py$', '') AS leaf, count(*) AS n, min(path) AS target FROM (SELECT DISTINCT repo_id, path FROM c WHERE path LIKE '%.py') GROUP BY 1, 2)
SELECT i.repo_id, i.path, module, CASE WHEN n = 1 THEN 'local' WHEN n > 1 THEN 'ambiguous' ELSE 'external' END AS resolution, CASE WHEN n = 1 THEN target END AS target FROM imp i LEFT JOIN idx ON idx.repo_id = i.repo_id AND idx.leaf = split_part(module, '.', -1)""",
    "symbol_definitions": _CALL + " SELECT repo_id, path, chunk_id, name FROM defs",
    "call_resolution": _CALL + """, loc AS (SELECT DISTINCT repo_id, path, name FROM defs), rep AS (SELECT repo_id, name, count(DISTINCT path) AS k FROM defs GROUP BY 1, 2)
SELECT CASE WHEN l.name IS NOT NULL THEN 'local' WHEN k = 1 THEN 'resolved' WHEN k > 1 THEN 'candidate' ELSE 'unresolved' END AS status, count(*) AS n_calls, sum(n) AS n_sites
FROM calls x LEFT JOIN loc l ON l.repo_id = x.repo_id AND l.path = x.path AND l.name = callee LEFT JOIN rep r ON r.repo_id = x.repo_id AND r.name = callee GROUP BY 1""",
    "callers": _CALL + """, d AS (SELECT DISTINCT repo_id, name AS callee, path AS defined_in FROM defs), x AS (SELECT repo_id, callee, path, sum(n) AS n_sites FROM calls GROUP BY 1, 2, 3)
SELECT repo_id, callee, defined_in, count(DISTINCT path) AS n_files, sum(n_sites) AS n_sites, min(path) AS first_file FROM x JOIN d USING (repo_id, callee) GROUP BY 1, 2, 3""",
    "callees": _CALL + """, d AS (SELECT DISTINCT repo_id, name AS callee, path AS target FROM defs)
SELECT repo_id, path, count(DISTINCT callee) AS n_callees, count(DISTINCT target) AS n_targets FROM (SELECT DISTINCT repo_id, path, callee FROM calls) JOIN d USING (repo_id, callee) WHERE target <> path GROUP BY 1, 2""",
    "references": _CALL + " SELECT callee, path, chunk_id, n FROM calls WHERE callee IN ('max', 'open', 'len')",
    "range_overlap_join": _C + " SELECT a.chunk_id AS a_id, b.chunk_id AS b_id FROM c a JOIN c b USING (repo_id, path) WHERE b.start_line = 1 AND a.start_line <= 40 AND a.end_line >= 10",
    "interval_union_coverage": _C + ", k AS (SELECT DISTINCT repo_id, path, start_line FROM c), t AS (SELECT DISTINCT repo_id, path, start_line - 10 AS a_start, start_line + 10 AS a_end FROM k WHERE start_line > 1), "
    + "m AS (SELECT repo_id, path, a_start, a_end, greatest(a_start, k.start_line) AS s, least(a_end, k.start_line + 6) AS e FROM t JOIN k USING (repo_id, path) WHERE k.start_line <= a_end AND k.start_line + 6 >= a_start), "
    + "u AS (SELECT repo_id, path, a_start, a_end, sum(\"end\" - start + 1) AS covered FROM " + _isl("m", "repo_id, path, a_start, a_end", "s", "e") + " GROUP BY 1, 2, 3, 4) "
    + "SELECT repo_id, path, a_start, a_end, coalesce(covered, 0) AS covered, round(coalesce(covered, 0) / (a_end - a_start + 1), 6) AS ratio FROM t LEFT JOIN u USING (repo_id, path, a_start, a_end)",
    "interval_islands": _C + ", k AS (SELECT DISTINCT repo_id, path, start_line, end_line FROM c) SELECT * FROM " + _isl("k", "repo_id, path", "start_line", "end_line"),
    "byte_to_line": "SELECT DISTINCT chunk_id, CAST(1 + len(CAST(encode(content)[1:200] AS VARCHAR)) - len(replace(CAST(encode(content)[1:200] AS VARCHAR), '\\x0A', '\\x0')) AS BIGINT) AS line FROM chunks WHERE content IS NOT NULL",
    "content_verification": """WITH x AS (SELECT DISTINCT chunk_id, content, nullif(regexp_replace(lower(trim(content_sha256)), '^[a-z0-9-]+:', ''), '') AS w, size_bytes FROM chunks)
SELECT CASE WHEN content IS NULL THEN 'no_content' WHEN w IS NULL THEN 'no_digest' WHEN w = sha256(content) THEN 'ok' ELSE 'mismatch' END AS content_status,
CASE WHEN size_bytes IS NULL OR content IS NULL THEN 'unknown' WHEN size_bytes = strlen(content) THEN 'ok' ELSE 'mismatch' END AS size_status, count(*) AS n FROM x GROUP BY 1, 2""",
    "chunk_ids": _C + " SELECT DISTINCT chunk_id, substr(sha1(concat(path, chr(10), start_line, chr(10), sha256(content))), 1, 20) AS stable_id FROM c WHERE content IS NOT NULL",
    "chunk_offsets": _C + " SELECT chunk_id, coalesce(sum(strlen(content)) OVER (PARTITION BY repo_id, path ORDER BY start_line, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS \"offset\" FROM c WHERE content IS NOT NULL",
    "redact_secrets": _C + f", r AS (SELECT chunk_id, content, {_rx()} AS clean FROM c WHERE content IS NOT NULL) SELECT chunk_id, md5(clean) AS md5 FROM r WHERE clean <> content",
    "content_first_match_snippet": """SELECT doc_id, snippet FROM (SELECT doc_id, substr(trim(list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'snapshot'))[1], ' '), 1, 200) AS snippet FROM (SELECT DISTINCT doc_id, text FROM documents)) WHERE snippet IS NOT NULL""",
    "retrieval_metadata": _C + """ SELECT DISTINCT chunk_id, regexp_extract(t, '\\A#!([^\\n]*)', 1) AS shebang, length(t) // 4 AS est_tokens,
array_to_string(list_sort(list_distinct(regexp_extract_all(t, '(?m)^(?:from|import)[ \\t]+([A-Za-z_][A-Za-z0-9_.]*)', 1)))[1:20], ',') AS imports,
array_to_string(list_sort(list_distinct(regexp_extract_all(t, '(?m)^[ \\t]*(?:def|class)[ \\t]+([A-Za-z_][A-Za-z0-9_]*)', 1)))[1:50], ',') AS symbols FROM (SELECT chunk_id, coalesce(content, '') AS t FROM c)""",
    "classify_paths": _CLASS + " SELECT repo_id, path, category, tags, ext FROM cls",
    "facet_counts": _CLASS + " SELECT repo_id, category, count(*) AS n_files, count(DISTINCT ext) AS n_ext FROM cls GROUP BY 1, 2",
    "repo_summary": _CLASS + """, b AS (SELECT repo_id, path, coalesce(sum(strlen(content)), 0) AS bytes FROM c GROUP BY 1, 2)
SELECT repo_id, count(*) AS total, count(*) FILTER (WHERE category IN ('source', 'doc', 'config', 'test', 'contract')) AS text_files, sum(bytes) AS bytes FROM cls JOIN b USING (repo_id, path) GROUP BY 1""",
    "token_estimates": "SELECT repo_id, sum(ceil(coalesce(size_bytes, 0) / 4)) AS est_tokens, count(*) AS n_chunks FROM (SELECT DISTINCT chunk_id, repo_id, size_bytes FROM chunks) GROUP BY 1",
    "cosine_topk": """SELECT query_id, rank, row_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM (
SELECT q.vec_id AS query_id, v.vec_id AS row_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)) WHERE rank <= 10""",
    "report_parts": """SELECT repo_id, part, count(*) AS n, sum(b) AS bytes FROM (SELECT repo_id, b, CAST(floor(coalesce(sum(b) OVER (PARTITION BY repo_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 5000) AS INT) + 1 AS part
FROM (SELECT DISTINCT repo_id, chunk_id, coalesce(size_bytes, 0) AS b FROM chunks)) GROUP BY 1, 2""",
    "bounded_sources": _C + ", b AS (SELECT repo_id, path, coalesce(sum(strlen(content)), 0) AS bytes FROM c GROUP BY 1, 2) SELECT * FROM (SELECT repo_id, path, sum(bytes) OVER (PARTITION BY repo_id ORDER BY path) AS running FROM b) WHERE running <= 20000",
    "precision_recall_multiset": _C + """, o AS (SELECT repo_id, path, start_byte, coalesce(sum(strlen(content)) OVER (PARTITION BY repo_id, path ORDER BY start_line, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM c WHERE content IS NOT NULL),
a AS (SELECT repo_id, path, off AS pos, count(*) AS na FROM o GROUP BY 1, 2, 3), e AS (SELECT repo_id, path, start_byte AS pos, count(*) AS ne FROM o GROUP BY 1, 2, 3),
s AS (SELECT sum(least(coalesce(na, 0), coalesce(ne, 0))) AS tp, sum(na) AS a, sum(ne) AS e FROM a FULL JOIN e USING (repo_id, path, pos))
SELECT tp, a - tp AS fp, e - tp AS fn, round(tp / a, 6) AS precision, round(tp / e, 6) AS recall FROM s""",
    "p95_nearest_rank": "SELECT event_type, list_sort(list(value))[CAST(round((count(value) - 1) * 0.95) AS BIGINT) + 1] AS p, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY 1",
    "tumbling_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "session_windows": """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS nw FROM events)) GROUP BY user_id, s""",
    "incremental_reuse": """WITH k AS (SELECT DISTINCT chunk_id, repo_id, path, content, batch_no FROM chunks), f AS (SELECT repo_id, path, list_sort(list(chunk_id || coalesce(content, '')) FILTER (WHERE batch_no < 9)) AS a, list_sort(list(chunk_id || coalesce(content, ''))) AS b FROM k GROUP BY 1, 2)
SELECT CASE WHEN a IS NULL OR len(a) = 0 THEN 'added' WHEN a = b THEN 'reused' ELSE 'changed' END AS state, count(*) AS n_files FROM f GROUP BY 1""",
    "churn": "SELECT repo_id, path, count(DISTINCT batch_no) AS n_batches FROM chunks GROUP BY 1, 2",
}
