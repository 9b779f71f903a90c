"""Structure of shell and Rust files, graph quality, freshness, latencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normal
from ..operators import structures as X
from ..operators.retrieval import file_context
from ..sources.tables import table
from .retrieval import chunks
from .structure import _delta_graph

NOW = "2025-12-01"


def _files(spark, base, like):
    return file_context(chunks(spark, base, "chunk_id", "repo_id", "path", "start_line", "content").where(F.col("path").like(like)))


def bash_functions(spark, base):
    return X.bash_functions(_files(spark, base, "%.sh"))


def rust_items(spark, base):
    return X.rust_items(_files(spark, base, "%.rs"))


def structure_counts(spark, base):
    """Functions and items per repository and language."""
    b = X.bash_functions(_files(spark, base, "%.sh")).select("repo_id", F.lit("function").alias("kind"), F.lit("bash").alias("language"))
    r = X.rust_items(_files(spark, base, "%.rs")).select("repo_id", "kind", F.lit("rust").alias("language"))
    return b.unionByName(r).groupBy("repo_id", "language", "kind").agg(F.count("*").alias("n"))


def graph_quality(spark, base):
    """Deltas of complete snapshots of one root to the next are expected edges; deltas of a snapshot to itself are forbidden."""
    _, edges, _ = _delta_graph(spark, base)
    s = table(spark, base, "snapshots", "snapshot_id", "root_id", "created_at", "status").where("status = 'complete'")
    s = s.select(normal.key("snapshot_id").alias("sid"), normal.key("root_id").alias("root"), "created_at").distinct()
    first = s.groupBy("root").agg(F.min(F.struct("created_at", "sid")).alias("a"), F.max(F.struct("created_at", "sid")).alias("b"))
    expected = first.select(F.col("a.sid").alias("src"), F.col("b.sid").alias("dst")).where("src <> dst")
    return X.edge_quality(expected, edges.select("src", F.col("src").alias("dst")), edges)


def machine_freshness(spark, base):
    m = table(spark, base, "machines", "machine_id", "last_seen_at").select(normal.key("machine_id").alias("machine"), "last_seen_at").where("machine is not null")
    m = m.groupBy("machine").agg(F.max("last_seen_at").alias("last_seen_at"))
    return X.freshness(m, F.lit(NOW).cast("timestamp_ntz"), "last_seen_at", 90).select("machine", "freshness")


def route_latencies(spark, base):
    e = table(spark, base, "events", "event_type", "user_id", "value").withColumn("band", F.pmod(F.col("user_id"), F.lit(3)).cast("string"))
    return X.route_latencies(e, "event_type", "value", "band")


QUERIES = {f.__name__: f for f in (bash_functions, rust_items, structure_counts, graph_quality, machine_freshness, route_latencies)}

_F = """WITH c AS (SELECT DISTINCT chunk_id, repo_id, path, start_line, content FROM chunks), f AS (SELECT repo_id, path, string_agg(coalesce(content, ''), '' ORDER BY start_line, chunk_id, coalesce(content, '')) AS t FROM c WHERE path LIKE '%.sh' OR path LIKE '%.rs' GROUP BY 1, 2),
sh AS (SELECT repo_id, path, i AS line_no, regexp_extract(ls[i], '""" + X.BASH_FUNCTION + """', 1) AS name FROM (SELECT repo_id, path, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT repo_id, path, string_split(t, chr(10)) AS ls FROM f WHERE path LIKE '%.sh'))),
rs AS (SELECT repo_id, path, i AS line_no, regexp_extract(ls[i], '""" + X.RUST_ITEM + """', 1) AS kind, regexp_extract(ls[i], '""" + X.RUST_ITEM + """', 2) AS name FROM (SELECT repo_id, path, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT repo_id, path, string_split(regexp_replace(regexp_replace(t, '"(?:[^"\\\\\\n]|\\\\.)*"', '""', 'g'), '//[^\\n]*', '', 'g'), chr(10)) AS ls FROM f WHERE path LIKE '%.rs')))"""
SQL = {
    "bash_functions": _F + " SELECT * FROM sh WHERE name <> ''",
    "rust_items": _F + " SELECT * FROM rs WHERE name <> ''",
    "structure_counts": _F + " SELECT repo_id, language, kind, count(*) AS n FROM (SELECT repo_id, 'bash' AS language, 'function' AS kind FROM sh WHERE name <> '' UNION ALL SELECT repo_id, 'rust', kind FROM rs WHERE name <> '') GROUP BY 1, 2, 3",
    "graph_quality": """WITH e AS (SELECT DISTINCT lower(trim(from_snapshot_id)) AS src, lower(trim(to_snapshot_id)) AS dst FROM deltas WHERE from_snapshot_id IS NOT NULL AND to_snapshot_id IS NOT NULL),
s AS (SELECT DISTINCT lower(trim(snapshot_id)) AS sid, lower(trim(root_id)) AS root, created_at FROM snapshots WHERE status = 'complete'), x AS (SELECT DISTINCT a AS src, b AS dst FROM (SELECT root, arg_min(sid, created_at) AS a, arg_max(sid, created_at) AS b FROM s GROUP BY 1) WHERE a <> b)
SELECT count(*) AS n_expected, count(e.src) AS n_found, round(count(e.src) / count(*), 6) AS recall, (SELECT count(*) FROM e WHERE src = dst) AS n_forbidden FROM x LEFT JOIN e ON e.src = x.src AND e.dst = x.dst""",
    "machine_freshness": f"SELECT machine, CASE WHEN t IS NULL THEN 'no_time' WHEN t > TIMESTAMP '{NOW}' THEN 'future' WHEN t < TIMESTAMP '{NOW}' - INTERVAL 90 DAY THEN 'stale' ELSE 'fresh' END AS freshness FROM (SELECT lower(trim(machine_id)) AS machine, max(last_seen_at) AS t FROM machines WHERE machine_id IS NOT NULL GROUP BY 1)",
    "route_latencies": """SELECT event_type, CASE WHEN GROUPING(band) = 1 THEN '(all)' ELSE band END AS band, count(value) AS n, round(median(value), 6) AS median, round(max(value), 6) AS greatest, round(sum(value), 4) AS total
FROM (SELECT event_type, value, CAST(((user_id % 3) + 3) % 3 AS VARCHAR) AS band FROM events) GROUP BY GROUPING SETS ((event_type), (event_type, band))""",
}
