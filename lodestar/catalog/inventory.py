"""Inventory, registry and retention queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normal
from ..operators import inventory as I
from ..operators import retention as K
from ..operators.snapshots import complete_sequence, held_rows
from ..sources.tables import table
from .integrity import _CHANGES


def _held(spark, base, *extra):
    files = table(spark, base, "files", "entry_id", "snapshot_id", "rel_path", "size_bytes", "mtime", "ingested_at", *extra)
    return held_rows(files, _seq(spark, base), *extra)


def _seq(spark, base):
    return complete_sequence(table(spark, base, "snapshots", "snapshot_id", "root_id", "created_at", "status", "ingested_at"))


def complete_snapshots(spark, base):
    s = table(spark, base, "snapshots", "snapshot_id", "machine_id", "root_id", "created_at", "status").distinct()
    return s.where("status = 'complete' and created_at >= '2025-06-01'").select("snapshot_id", "machine_id", "root_id", "created_at")


def latest_snapshot_per_root(spark, base):
    s = table(spark, base, "snapshots", "snapshot_id", "machine_id", "root_id", "created_at", "status").where("status = 'complete'")
    s = s.select(normal.key("machine_id").alias("machine"), normal.key("root_id").alias("root"), normal.key("snapshot_id").alias("sid"), "created_at").distinct()
    return I.latest_per_group(s, ["machine", "root"], F.desc("created_at"), F.desc("sid"))


def machine_health(spark, base):
    return I.machine_health(table(spark, base, "machines", "machine_id"), table(spark, base, "snapshots", "machine_id", "snapshot_id", "created_at", "status"))


def inventory_query(spark, base):
    f = table(spark, base, "files", "entry_id", "snapshot_id", "rel_path", "ext", "size_bytes").distinct()
    s = table(spark, base, "snapshots", "snapshot_id", "status").where("status = 'complete'").select(normal.key("snapshot_id").alias("sid")).distinct()
    f = f.where("ext in ('.py', '.json') and size_bytes between 500 and 5000").withColumn("sid", normal.key("snapshot_id"))
    return f.join(s, "sid", "left_semi").select("entry_id", "sid", "rel_path", "size_bytes")


def registry_upsert(spark, base):
    """Latest row per machine key: what insert-or-replace leaves."""
    m = table(spark, base, "machines", "machine_id", "hostname", "ingested_at", "deleted_at").distinct().withColumn("machine", normal.key("machine_id"))
    return I.latest_per_group(m, ["machine"], F.desc("ingested_at"), F.desc("hostname")).select("machine", "hostname", "ingested_at")


def duplicates(spark, base):
    f = table(spark, base, "files", "entry_id", "rel_path", "size_bytes", "checksum", "quick_hash").dropDuplicates(["entry_id"])
    return I.duplicates(f).select("size_bytes", "key_kind", "key", "n", "verified", "wasted_bytes", "first_path")


def first_last_diff(spark, base):
    """Comparison of the first and the last complete snapshot of every root at once."""
    h = _held(spark, base).withColumn("last", F.expr("next_sid is null"))
    key = F.concat_ws("\x1f", "root", "path")
    return I.compare_sets(h.where("seq = 1").withColumn("k", key), h.where("last").withColumn("k", key), "k", "size", "mtime_at").groupBy("status").agg(F.count("*").alias("n"))


def orphan_files(spark, base):
    """Paths only in the last (orphan) or only in the first (dead) complete snapshot of a root."""
    h = _held(spark, base).withColumn("k", F.concat_ws("\x1f", "root", "path"))
    return I.orphans_and_dead(h.where("next_sid is null"), h.where("seq = 1"), "k").groupBy("kind").agg(F.count("*").alias("n"))


def growth(spark, base):
    return I.growth(_held(spark, base)).select("sid", "bytes", "files", "bytes_delta", "files_delta")


def file_history(spark, base):
    return I.file_history(_held(spark, base)).select("path", "sid", "state")


def ancestor_rollup(spark, base):
    return I.ancestor_rollup(_held(spark, base)).select("sid", "dir", "n_files", "n_bytes")


def directory_fingerprints(spark, base):
    return I.directory_fingerprints(_held(spark, base))


def disk_hotspots(spark, base):
    return I.disk_hotspots(_held(spark, base))


def extension_histogram(spark, base):
    f = table(spark, base, "files", "entry_id", "ext", "size_bytes", "is_text").dropDuplicates(["entry_id"])
    return f.groupBy("ext").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"), F.count_if("is_text").alias("n_text"))


def span_ranking(spark, base):
    return I.spans(table(spark, base, "chunks", "chunk_id", "repo_id", "path", "start_line", "end_line").distinct())


def store_diagnostics(spark, base):
    s = table(spark, base, "snapshots", "snapshot_id", "status", "created_at").distinct()
    return s.groupBy("status").agg(F.count("*").alias("n"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


def _store(spark, base):
    s = table(spark, base, "snapshots", "snapshot_id", "root_id", "created_at", "status").where("root_id is not null").distinct()
    return s.select(normal.key("root_id").alias("root"), normal.key("snapshot_id").alias("sid"), "created_at", "status").dropDuplicates(["sid"])


def retention_plan(spark, base):
    e = table(spark, base, "events", "event_id", "user_id", "ts", "value").select("user_id", F.col("event_id").cast("string").alias("id"), "ts", F.floor(F.coalesce("value", F.lit(0.0))).cast("long").alias("bytes"), (F.col("event_id") % 7 == 0).alias("pinned"))
    return K.retention_plan(e, "user_id", "id", "ts", "bytes", "pinned", "2024-01-20", 15, 60, 400)


def keep_n_newest(spark, base):
    return K.keep_newest(_store(spark, base), "root", "created_at", "sid", 2).select("root", "sid", "rank")


def period_anchor_retention(spark, base):
    return K.period_anchors(_store(spark, base), "root", "created_at", "sid", 1, 2, 3)


QUERIES = {f.__name__: f for f in (complete_snapshots, latest_snapshot_per_root, machine_health, inventory_query, registry_upsert, duplicates, first_last_diff, orphan_files, growth, file_history, ancestor_rollup,
    directory_fingerprints, disk_hotspots, extension_histogram, span_ranking, store_diagnostics, retention_plan, keep_n_newest, period_anchor_retention)}

_K = "lower(trim({}))"
_H = _CHANGES + ",\nh AS (SELECT held.* FROM held)"
SQL = {
    "complete_snapshots": "SELECT DISTINCT snapshot_id, machine_id, root_id, created_at FROM snapshots WHERE status = 'complete' AND created_at >= '2025-06-01'",
    "latest_snapshot_per_root": """SELECT machine, root, sid, created_at FROM (SELECT *, row_number() OVER (PARTITION BY machine, root ORDER BY created_at DESC, sid DESC) AS k FROM (
SELECT DISTINCT lower(trim(machine_id)) AS machine, lower(trim(root_id)) AS root, lower(trim(snapshot_id)) AS sid, created_at FROM snapshots WHERE status = 'complete')) WHERE k = 1""",
    "machine_health": """SELECT m.machine, count(DISTINCT sid) AS n_complete, max(created_at) AS last_complete_at FROM (SELECT DISTINCT lower(trim(machine_id)) AS machine FROM machines) m
LEFT JOIN (SELECT DISTINCT lower(trim(machine_id)) AS sm, lower(trim(snapshot_id)) AS sid, created_at, status FROM snapshots) s ON m.machine = s.sm AND s.status = 'complete' GROUP BY 1""",
    "inventory_query": """SELECT DISTINCT entry_id, lower(trim(snapshot_id)) AS sid, rel_path, size_bytes FROM files WHERE ext IN ('.py', '.json') AND size_bytes BETWEEN 500 AND 5000
AND lower(trim(snapshot_id)) IN (SELECT lower(trim(snapshot_id)) FROM snapshots WHERE status = 'complete')""",
    "registry_upsert": "SELECT machine, hostname, ingested_at FROM (SELECT *, row_number() OVER (PARTITION BY machine ORDER BY ingested_at DESC, hostname DESC NULLS LAST) AS k FROM (SELECT DISTINCT lower(trim(machine_id)) AS machine, hostname, ingested_at, deleted_at FROM machines)) WHERE k = 1",
    "duplicates": """WITH f AS (SELECT DISTINCT entry_id, rel_path, size_bytes, nullif(regexp_replace(lower(trim(checksum)), '^[a-z0-9-]+:', ''), '') AS s, lower(trim(quick_hash)) AS q FROM files)
SELECT size_bytes, key_kind, key, n, key_kind = 'checksum' AS verified, size_bytes * (n - 1) AS wasted_bytes, first_path FROM (
SELECT size_bytes, CASE WHEN s IS NOT NULL THEN 'checksum' ELSE 'quick_hash' END AS key_kind, coalesce(s, q) AS key, count(*) AS n, min(rel_path) AS first_path FROM f WHERE coalesce(s, q) IS NOT NULL AND size_bytes IS NOT NULL GROUP BY 1, 2, 3) WHERE n > 1""",
    "first_last_diff": _H + """ SELECT status, count(*) AS n FROM (SELECT CASE WHEN a.sid IS NULL THEN 'new' WHEN b.sid IS NULL THEN 'removed' WHEN a.size IS NOT DISTINCT FROM b.size AND a.m IS NOT DISTINCT FROM b.m THEN 'same' ELSE 'changed' END AS status
FROM (SELECT * FROM h WHERE seq = 1) a FULL JOIN (SELECT * FROM h WHERE next_sid IS NULL) b ON a.root = b.root AND a.path = b.path) GROUP BY 1""",
    "orphan_files": _H + """ SELECT 'orphan' AS kind, count(*) AS n FROM (SELECT root, path FROM h WHERE next_sid IS NULL EXCEPT SELECT root, path FROM h WHERE seq = 1)
UNION ALL SELECT 'dead', count(*) FROM (SELECT root, path FROM h WHERE seq = 1 EXCEPT SELECT root, path FROM h WHERE next_sid IS NULL)""",
    "growth": _H + """, g AS (SELECT root, seq, sid, sum(greatest(size, 0)) AS bytes, count(*) AS files FROM h GROUP BY 1, 2, 3)
SELECT sid, bytes, files, bytes - lag(bytes) OVER w AS bytes_delta, files - lag(files) OVER w AS files_delta FROM g WINDOW w AS (PARTITION BY root ORDER BY seq)""",
    "file_history": _H + """ SELECT b.path, b.sid, CASE WHEN a.sid IS NULL THEN 'CREATED' WHEN a.size IS NOT DISTINCT FROM b.size AND a.m IS NOT DISTINCT FROM b.m THEN 'UNCHANGED' ELSE 'MODIFIED' END AS state
FROM h b LEFT JOIN h a ON a.root = b.root AND a.path = b.path AND a.seq = b.seq - 1
UNION ALL SELECT a.path, a.next_sid, 'DELETED' FROM h a WHERE a.next_sid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM h b WHERE b.root = a.root AND b.path = a.path AND b.seq = a.seq + 1)""",
    "ancestor_rollup": _H + """, p AS (SELECT sid, size, string_split(path, '/') AS parts FROM h), a AS (SELECT sid, size, parts, unnest(range(len(parts))) AS i FROM p)
SELECT sid, array_to_string(parts[1:i], '/') AS dir, count(*) AS n_files, sum(size) AS n_bytes FROM a GROUP BY 1, 2""",
    "directory_fingerprints": _H + """ SELECT sid, regexp_replace(path, '/?[^/]+$', '') AS dir, count(*) AS n,
CAST(sum(CAST('0x' || substr(md5(concat_ws(chr(31), path, coalesce(CAST(size AS VARCHAR), chr(30)), coalesce(CAST(m AS VARCHAR), chr(30)))), 1, 15) AS BIGINT)::HUGEINT) AS VARCHAR) AS fingerprint FROM h GROUP BY 1, 2""",
    "disk_hotspots": _H + " (SELECT 'largest' AS kind, sid, path, size FROM h ORDER BY size DESC NULLS LAST, sid, path LIMIT 50) UNION ALL (SELECT 'oldest', sid, path, size FROM h WHERE m IS NOT NULL ORDER BY m, sid, path LIMIT 50)",
    "extension_histogram": "SELECT ext, count(*) AS n, sum(size_bytes) AS bytes, count(*) FILTER (WHERE is_text) AS n_text FROM (SELECT DISTINCT ON (entry_id) entry_id, ext, size_bytes, is_text FROM files) GROUP BY 1",
    "span_ranking": """SELECT path, CASE WHEN a = b THEN a END AS repo_id, n_chunks, first_line, last_line FROM (SELECT path, count(*) AS n_chunks, min(start_line) AS first_line, max(end_line) AS last_line, min(repo_id) AS a, max(repo_id) AS b
FROM (SELECT DISTINCT chunk_id, repo_id, path, start_line, end_line FROM chunks) GROUP BY 1) ORDER BY n_chunks DESC, last_line - first_line DESC, repo_id NULLS FIRST, path LIMIT 30""",
    "store_diagnostics": "SELECT status, count(*) AS n, min(created_at) AS oldest, max(created_at) AS newest FROM (SELECT DISTINCT snapshot_id, status, created_at FROM snapshots) GROUP BY 1",
    "retention_plan": """WITH e AS (SELECT user_id, CAST(event_id AS VARCHAR) AS id, ts, CAST(floor(coalesce(value, 0)) AS BIGINT) AS bytes, event_id % 7 = 0 AS pinned FROM events),
b AS (SELECT *, NOT pinned AND coalesce(ts < TIMESTAMP '2024-01-20' - INTERVAL 15 DAY, true) AS age FROM e),
l AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id, pinned ORDER BY ts NULLS FIRST, id) AS rn FROM b WHERE NOT age),
c AS (SELECT *, NOT pinned AND rn <= n - 60 AS cnt FROM l),
r AS (SELECT *, sum(bytes) OVER (PARTITION BY user_id) AS total, coalesce(sum(bytes) OVER (PARTITION BY user_id, pinned ORDER BY ts NULLS FIRST, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c WHERE NOT cnt)
SELECT user_id, id, 'age' AS reason FROM b WHERE age UNION ALL SELECT user_id, id, 'count' FROM c WHERE cnt UNION ALL SELECT user_id, id, 'bytes' FROM r WHERE NOT pinned AND before < total - 400""",
    "keep_n_newest": """SELECT root, sid, rank FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY created_at DESC, sid DESC) AS rank FROM (
SELECT DISTINCT lower(trim(root_id)) AS root, lower(trim(snapshot_id)) AS sid, created_at FROM snapshots WHERE root_id IS NOT NULL)) WHERE rank <= 2""",
    "period_anchor_retention": """WITH s AS (SELECT DISTINCT lower(trim(root_id)) AS root, lower(trim(snapshot_id)) AS sid, created_at FROM snapshots WHERE root_id IS NOT NULL),
x AS (SELECT *, date_trunc('day', created_at) AS d, date_trunc('week', created_at) AS w FROM s),
y AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY created_at DESC, sid DESC) AS n, row_number() OVER (PARTITION BY root, d ORDER BY created_at DESC, sid DESC) AS dn, row_number() OVER (PARTITION BY root, w ORDER BY created_at DESC, sid DESC) AS wn,
dense_rank() OVER (PARTITION BY root ORDER BY d DESC) AS dr, dense_rank() OVER (PARTITION BY root ORDER BY w DESC) AS wr FROM x),
z AS (SELECT root, sid, array_to_string(list_filter([CASE WHEN n <= 1 THEN 'recent' END, CASE WHEN dn = 1 AND dr <= 2 THEN 'daily' END, CASE WHEN wn = 1 AND wr <= 3 THEN 'weekly' END], lambda q: q IS NOT NULL), ',') AS reasons FROM y)
SELECT * FROM z WHERE reasons <> ''""",
}
