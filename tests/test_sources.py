from pyspark.sql import functions as F

from lodestar.sources import jsonl, scan
from lodestar.streaming import watch


def test_chunk_lines_with_aliases_and_counters(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"chunk_id": "c1", "repo": "r", "path": "a.py", "sha256": "x", "size": 3}\nnot json\n{"path": "b"}\n\n{"chunk_id": "c2", "repo_id": "r2", "size_bytes": 4}\n')
    rows = jsonl.read_chunks(spark, str(tmp_path / "c.jsonl"))
    assert {(r.chunk_id, r.repo_id, r.size_bytes) for r in rows.where("line_status = 'ok'").collect()} == {("c1", "r", 3), ("c2", "r2", 4)}
    assert {r.line_status: r.n_lines for r in jsonl.ingest_counters(rows).collect()} == {"ok": 2, "invalid_json": 1, "missing_id": 1}


def test_inventory_last_line_holds_and_publish(spark, tmp_path):
    (tmp_path / "i.jsonl").write_text('{"rel_path": "a", "size_bytes": 1}\n{"rel_path": "a", "size_bytes": 2}\n')
    inv = jsonl.read_inventory(spark, str(tmp_path / "i.jsonl"))
    assert [r.size_bytes for r in inv.collect()] == [2]
    jsonl.publish(inv, str(tmp_path / "out"), "g1")
    jsonl.publish(inv.limit(0), str(tmp_path / "out"), "g2")
    assert jsonl.current(spark, str(tmp_path / "out")).count() == 0
    # a job that is lost before its pointer is whole leaves the last one in force
    (tmp_path / "out/generations/g3").mkdir()
    assert jsonl.current(spark, str(tmp_path / "out")).count() == 0


def test_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x\ny\n")
    (tmp_path / "b.bin").write_bytes(b"\0\1")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git/c").write_text("no")
    rows = {r.rel_path: r for r in scan.scan_repository(spark, str(tmp_path)).collect()}
    assert set(rows) == {"src/a.py", "b.bin"} and rows["src/a.py"].line_count == 2 and not rows["b.bin"].is_text and rows["b.bin"].content is None


def test_diff_hunks(spark):
    text = "--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@ def f\n a\n-b\n+c\n+d\n@@ -9 +10 @@\n-q\n+r\n--- /dev/null\n+++ b/new.txt\n@@ -0,0 +1 @@\n+--- not a header\n"
    got = scan.parse_diffs(spark.createDataFrame([("d", text), ("e", None)], "diff_id string, diff_text string")).collect()
    assert [(r.path, r.change_status, r.old_start, r.new_start, r.added, r.removed) for r in got] == [("x.py", "modified", 1, 1, 2, 1), ("x.py", "modified", 9, 10, 1, 1), ("new.txt", "added", 0, 1, 1, 0)]


def test_markdown_and_globs(spark):
    t = spark.createDataFrame([(1, "| a | b |\n|---|---|\n| 1 | 2 |\nno")], "k int, t string")
    assert [r.cells for r in scan.markdown_tables(t, "k", "t").orderBy("row_no").collect()] == [["a", "b"], ["1", "2"]]
    p = spark.createDataFrame([("src/a.py",), ("src/b.js",)], "p string")
    assert p.where(scan.glob_filter(F.col("p"), "src/*.py")).count() == 1


def test_stream_twice_equals_batch(spark, tmp_path):
    base = str(tmp_path)
    rows = [("a", 1), ("b", 2), ("a", 1)]
    df = spark.createDataFrame(rows, "k string, v int").withColumn("ingested_at", F.to_timestamp_ntz(F.lit("2025-01-01")))
    df.repartition(3).write.parquet(f"{base}/t.parquet")
    out = watch.run_to_table(watch.ingest_once(watch.watched(spark, base, "t", 1), "k"), target=f"{base}/out")
    assert spark.read.parquet(out).count() == 2
    watch.run_to_table(watch.ingest_once(watch.watched(spark, base, "t", 1), "k"), target=f"{base}/out")
    assert spark.read.parquet(out).count() == 2
