from datetime import datetime as D

from lodestar.operators import inventory as I
from lodestar.operators.snapshots import complete_sequence, held_rows, snapshot_changes

FILES = "entry_id long, snapshot_id string, rel_path string, size_bytes long, mtime string, ingested_at timestamp_ntz, sid string, root string"
SNAPS = "snapshot_id string, root_id string, created_at timestamp_ntz, status string, ingested_at timestamp_ntz, seq int"


def frames(spark):
    t = lambda d, h=0: D(2025, 1, d, h)
    snaps = [("S1", "r", t(1), "complete", t(1), 9), ("s2", " R ", t(2), "complete", t(2), 9), ("s3", "r", t(3), "failed", t(3), 9), ("s4", "r", t(4), "complete", t(4), 9), ("s1", "r", t(1), "complete", t(1), 9), (None, "r", t(5), "complete", t(5), 9), ("s9", None, t(5), "complete", t(5), 9)]
    files = [
        (1, "s1", "./a//b.txt", 1, "2025-01-01T00:00:00Z", t(1), "x", "y"), (2, "S1 ", "c\\d", 2, "1735689600", t(1), "x", "y"), (3, "s1", None, 2, None, t(1), "x", "y"),
        (4, "s2", "a/b.txt", 1, "2025-01-01T01:00:00+01:00", t(2), "x", "y"), (5, "s2", "n̈ew", 5, None, t(2), "x", "y"), (6, "s2", "ṅew".replace("ṅ", "n̈"), 6, None, t(2, 5), "x", "y"),
        (4, "s2", "a/b.txt", 1, "2025-01-01T01:00:00+01:00", t(2), "x", "y"), (7, "s3", "bad", 1, None, t(3), "x", "y"), (8, "s4", "a/b.txt", None, "2025-01-01 00:00:00Z", t(4), "x", "y"), (9, "s4", "c/d", 2, "1735689600", t(4), "x", "y"),
    ]
    return spark.createDataFrame(files, FILES), spark.createDataFrame(snaps, SNAPS)


def test_changes_with_spellings_repeats_nulls_and_clashing_names(spark):
    files, snaps = frames(spark)
    got = {(r.snapshot_id, r.rel_path, r.change_kind) for r in snapshot_changes(files, snaps).collect()}
    assert got == {("s2", "c/d", "removed"), ("s2", "n̈ew", "added"), ("s4", "a/b.txt", "changed"), ("s4", "c/d", "added"), ("s4", "n̈ew", "removed")}


def test_late_correction_holds_and_history(spark):
    files, snaps = frames(spark)
    held = held_rows(files, complete_sequence(snaps))
    assert {r["size"] for r in held.where("path like '%ew'").collect()} == {6}
    states = {(r.path, r.sid): r.state for r in I.file_history(held).collect()}
    assert states["a/b.txt", "s2"] == "UNCHANGED" and states["a/b.txt", "s4"] == "MODIFIED" and states["c/d", "s2"] == "DELETED" and states["c/d", "s4"] == "CREATED"


def test_empty_tables(spark):
    files, snaps = frames(spark)
    assert snapshot_changes(files.limit(0), snaps).count() == 0
    assert snapshot_changes(files, snaps.limit(0)).count() == 0


def test_range_partitioning_serves_merge_without_second_shuffle(spark):
    files, snaps = frames(spark)
    plan = snapshot_changes(files, snaps)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1


def test_duplicates_and_rollup(spark):
    rows = spark.createDataFrame([("a", 100, "sha256:AB", None), ("b", 100, "ab", "q"), ("c", 200, None, "Q1"), ("d", 200, None, "q1"), ("e", 9, None, None)], "rel_path string, size_bytes long, checksum string, quick_hash string")
    got = {(r.size_bytes, r.key_kind, r.n, r.wasted_bytes) for r in I.duplicates(rows).collect()}
    assert got == {(100, "checksum", 2, 100), (200, "quick_hash", 2, 200)}
    f = spark.createDataFrame([("s", "a/b/c.txt", 1, "1"), ("s", "a/d", 2, "2")], "sid string, path string, size long, mtime_at string")
    assert {(r.dir, r.n_files, r.n_bytes) for r in I.ancestor_rollup(f).collect()} == {("", 2, 3), ("a", 2, 3), ("a/b", 1, 1)}
