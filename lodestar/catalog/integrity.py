"""Snapshot changes and orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.references import orphan_cascade, orphan_report
from ..operators.snapshots import snapshot_changes
from ..sources.tables import table


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    files = table(spark, base, "files", "entry_id", "snapshot_id", "rel_path", "size_bytes", "mtime", "ingested_at")
    snaps = table(spark, base, "snapshots", "snapshot_id", "root_id", "created_at", "status", "ingested_at")
    return snapshot_changes(files, snaps).select("snapshot_id", "rel_path", "change_kind").distinct()


def p3_change_counts(spark: SparkSession, base: str) -> DataFrame:
    return p3_found(spark, base).groupBy("snapshot_id", "change_kind").agg(F.count("*").alias("n_paths"))


def _tables(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    return {
        "machines": table(spark, base, "machines", "machine_id", "ingested_at", "deleted_at"),
        "roots": table(spark, base, "roots", "root_id", "machine_id", "ingested_at", "deleted_at"),
        "snapshots": table(spark, base, "snapshots", "snapshot_id", "root_id", "ingested_at", "deleted_at"),
        "deltas": table(spark, base, "deltas", "delta_id", "from_snapshot_id", "to_snapshot_id", "ingested_at"),
    }


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    rows = orphan_cascade(_tables(spark, base)).where("orphan_kind = 'direct'")
    return rows.select("child_table", "child_key", "ref_field").distinct()


def p5_report(spark: SparkSession, base: str) -> DataFrame:
    return orphan_report(orphan_cascade(_tables(spark, base)))


_CHANGES = """
WITH seq0 AS (
  SELECT lower(trim(snapshot_id)) AS sid, arg_max(lower(trim(root_id)), ingested_at) AS root, arg_max(created_at, ingested_at) AS created_at
  FROM snapshots WHERE status = 'complete' AND root_id IS NOT NULL AND created_at IS NOT NULL GROUP BY 1),
seq AS (SELECT *, row_number() OVER w AS seq, lead(sid) OVER w AS next_sid FROM seq0 WINDOW w AS (PARTITION BY root ORDER BY created_at, sid)),
f AS (
  SELECT lower(trim(snapshot_id)) AS sid,
    regexp_replace(regexp_replace(replace(nfc_normalize(rel_path), '\\', '/'), '/{2,}', '/', 'g'), '^(\\./)+', '') AS path,
    size_bytes AS size, entry_id, ingested_at,
    CASE WHEN regexp_full_match(trim(mtime), '[0-9]+') THEN CAST(trim(mtime) AS BIGINT) * 1000000
         ELSE epoch_us(CAST(replace(mtime, ' ', 'T') AS TIMESTAMPTZ)) END AS m
  FROM files WHERE rel_path IS NOT NULL),
held AS (
  SELECT seq.root, f.path, seq.seq, seq.sid, seq.next_sid, f.size, f.m FROM f JOIN seq USING (sid)
  QUALIFY row_number() OVER (PARTITION BY seq.sid, f.path ORDER BY f.ingested_at DESC, f.entry_id DESC) = 1),
changes AS (
  SELECT b.sid AS snapshot_id, b.path AS rel_path, CASE WHEN a.sid IS NULL THEN 'added' ELSE 'changed' END AS change_kind
  FROM held b LEFT JOIN held a ON a.root = b.root AND a.path = b.path AND a.seq = b.seq - 1
  WHERE b.seq > 1 AND (a.sid IS NULL OR a.size IS DISTINCT FROM b.size OR a.m IS DISTINCT FROM b.m)
  UNION
  SELECT a.next_sid, a.path, 'removed' FROM held a
  WHERE a.next_sid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM held b WHERE b.root = a.root AND b.path = a.path AND b.seq = a.seq + 1))
"""

_REFS = """
WITH refs AS (
  SELECT DISTINCT 'roots' AS child_table, root_id AS child_key, 'machine_id' AS ref_field, lower(trim(machine_id)) AS ref_key, ingested_at, 'machines' AS parent FROM roots
  UNION SELECT 'snapshots', snapshot_id, 'root_id', lower(trim(root_id)), ingested_at, 'roots' FROM snapshots
  UNION SELECT 'deltas', delta_id, 'from_snapshot_id', lower(trim(from_snapshot_id)), ingested_at, 'snapshots' FROM deltas
  UNION SELECT 'deltas', delta_id, 'to_snapshot_id', lower(trim(to_snapshot_id)), ingested_at, 'snapshots' FROM deltas),
parents AS (
  SELECT 'machines' AS parent, lower(trim(machine_id)) AS k, ingested_at AS f, deleted_at AS t FROM machines
  UNION SELECT 'roots', lower(trim(root_id)), ingested_at, deleted_at FROM roots
  UNION SELECT 'snapshots', lower(trim(snapshot_id)), ingested_at, deleted_at FROM snapshots),
direct AS (
  SELECT r.* FROM refs r WHERE ref_key IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM parents p WHERE p.parent = r.parent AND p.k = r.ref_key AND p.f <= r.ingested_at AND (p.t IS NULL OR p.t > r.ingested_at)))
"""

SQL = {
    "p3_found": _CHANGES + "SELECT DISTINCT * FROM changes",
    "p3_change_counts": _CHANGES + "SELECT snapshot_id, change_kind, count(*) AS n_paths FROM (SELECT DISTINCT * FROM changes) GROUP BY 1, 2",
    "p5_found": _REFS + "SELECT DISTINCT child_table, child_key, ref_field FROM direct",
    "p5_report": _REFS
    + """, live AS (SELECT r.* FROM refs r WHERE ref_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM direct d WHERE d.child_table = r.child_table AND d.ref_field = r.ref_field AND d.child_key = r.child_key AND d.ref_key = r.ref_key)),
bad_roots AS (SELECT DISTINCT lower(trim(child_key)) AS k FROM direct WHERE child_table = 'roots'),
low_snaps AS (SELECT l.* FROM live l WHERE l.child_table = 'snapshots' AND l.ref_key IN (SELECT k FROM bad_roots)),
bad_snaps AS (SELECT lower(trim(child_key)) AS k FROM direct WHERE child_table = 'snapshots' UNION SELECT lower(trim(child_key)) FROM low_snaps),
low_deltas AS (SELECT l.* FROM live l WHERE l.child_table = 'deltas' AND l.ref_key IN (SELECT k FROM bad_snaps)),
every AS (SELECT *, 'direct' AS orphan_kind FROM direct UNION ALL SELECT *, 'inherited' FROM low_snaps UNION ALL SELECT *, 'inherited' FROM low_deltas)
SELECT child_table, ref_field, orphan_kind, strftime(ingested_at, '%Y-%m') AS period, count(*) AS n_references, count(DISTINCT child_key) AS n_children
FROM every GROUP BY 1, 2, 3, 4""",
}
QUERIES = {"p3_found": p3_found, "p3_change_counts": p3_change_counts, "p5_found": p5_found, "p5_report": p5_report}
