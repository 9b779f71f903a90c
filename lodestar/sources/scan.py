"""Repository scan, unified diffs and Markdown tables as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_repository(spark: SparkSession, root: str, extensions: Sequence[str] = (), path_contains: str = "", max_bytes: int = 0, skip_dirs: Sequence[str] = (".git", "node_modules", "__pycache__")) -> DataFrame:
    """(rel_path, ext, size, mtime, md5, quick_hash, is_text, line_count, content) of the files below a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(root.rstrip("/")) + "/", "")
    rows = rows.select(rel.alias("rel_path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.col("content").alias("data"))
    rows = rows.where(~F.arrays_overlap(F.split("rel_path", "/"), F.array(*map(F.lit, skip_dirs))))
    ext = F.lower(F.regexp_extract("rel_path", r"(\.[^./]+)$", 1))
    if extensions:
        rows = rows.where(ext.isin(*extensions))
    if path_contains:
        rows = rows.where(F.lower("rel_path").contains(path_contains.lower()))
    is_text = ~F.contains(F.substring("data", 1, 4096), F.lit(b"\0"))
    head, tail = F.substring("data", 1, 4096), F.when(F.col("size") > 4096, F.expr("substring(data, greatest(4097, cast(size as int) - 4095))")).otherwise(F.lit(b""))
    text = F.when(is_text & ((F.lit(max_bytes) == 0) | (F.col("size") <= max_bytes)), F.decode("data", "utf-8"))
    lines = F.length(F.regexp_replace(F.decode("data", "ISO-8859-1"), "[^\\n]", ""))
    return rows.select("rel_path", ext.alias("ext"), "size", "mtime", F.md5("data").alias("md5"), F.md5(F.concat(head, tail)).alias("quick_hash"), is_text.alias("is_text"), F.when(is_text, lines).alias("line_count"), text.alias("content"))


def glob_filter(column: Column, pattern: str) -> Column:
    """fnmatch-like pattern on a path or name."""
    rx = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return column.rlike(f"^(?:{rx})$")


_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@ ?(.*)$")
HUNKS = "diff_id string, path string, old_path string, change_status string, old_start int, old_lines int, new_start int, new_lines int, added int, removed int, header string"


def _hunks(diff_id: str, text: str) -> Iterator[tuple]:
    old = new = None
    status, hunk = "modified", None
    left_old = left_new = 0
    for line in (text or "").splitlines():
        if hunk and (left_old > 0 or left_new > 0):
            c = line[:1]
            if c == "+":
                left_new -= 1
                hunk[9] += 1
                continue
            if c == "-":
                left_old -= 1
                hunk[10] += 1
                continue
            if c in (" ", ""):
                left_old, left_new = left_old - 1, left_new - 1
                continue
            if c == "\\":
                continue
        m = _HUNK.match(line)
        if m:
            if hunk:
                yield tuple(hunk[:4] + hunk[4:])
            o, n = int(m[2] if m[2] is not None else 1), int(m[4] if m[4] is not None else 1)
            path = new if new not in (None, "/dev/null") else old
            state = "added" if old == "/dev/null" else "deleted" if new == "/dev/null" else "renamed" if old != new else status
            hunk = [diff_id, path, old, state, int(m[1]), o, int(m[3]), n, m[5], 0, 0]
            left_old, left_new = o, n
        elif line.startswith("--- "):
            if hunk:
                yield tuple(hunk)
                hunk = None
            old = re.sub(r"^[ab]/", "", line[4:].split("\t")[0])
        elif line.startswith("+++ "):
            new = re.sub(r"^[ab]/", "", line[4:].split("\t")[0])
    if hunk:
        yield tuple(hunk)


def parse_diffs(diffs: DataFrame) -> DataFrame:
    """Hunks of unified diffs (diff_id, diff_text): a stateful line parser, one diff at a time."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [h for i, t in zip(b["diff_id"], b["diff_text"]) for h in _hunks(i, t)]
            out = pd.DataFrame(rows, columns=["diff_id", "path", "old_path", "change_status", "old_start", "old_lines", "new_start", "new_lines", "header", "added", "removed"])
            yield out[["diff_id", "path", "old_path", "change_status", "old_start", "old_lines", "new_start", "new_lines", "added", "removed", "header"]]

    return diffs.select("diff_id", "diff_text").mapInPandas(parse, HUNKS)


def markdown_tables(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Cells of Markdown table rows: (key, row_no, cells); separator rows are left out."""
    rows = texts.select(key, F.posexplode(F.split(text, "\n")).alias("row_no", "line")).where(F.col("line").rlike(r"^\s*\|.*\|\s*$") & ~F.col("line").rlike(r"^[\s|:-]+$"))
    return rows.select(key, "row_no", F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x)).alias("cells"))
