"""Analyses of file inventories and of the snapshot registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normal
from ..session import stored
from .retrieval import row_sum


def latest_per_group(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First row of each group in a total order (no group is gathered)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def machine_health(machines: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Every machine with its complete snapshots: the status stands in the join, not in a filter."""
    s = snapshots.select(normal.key("machine_id").alias("sm"), normal.key("snapshot_id").alias("sid"), "created_at", "status").distinct()
    m = machines.select(normal.key("machine_id").alias("machine")).distinct()
    joined = m.join(s, (F.col("machine") == F.col("sm")) & (F.col("status") == "complete"), "left")
    return joined.groupBy("machine").agg(F.count_distinct("sid").alias("n_complete"), F.max("created_at").alias("last_complete_at"))


def duplicates(rows: DataFrame) -> DataFrame:
    """Groups of equal content: by (size, checksum), else by (size, quick_hash); wasted = size * (n - 1).

    ``verified`` is true for checksum groups. Hot groups are counted, never listed.
    """
    sum_, quick = normal.digest("checksum"), normal.key("quick_hash")
    kind = F.when(sum_.isNotNull(), "checksum").when(quick.isNotNull(), "quick_hash")
    keyed = rows.withColumns({"key_kind": kind, "key": F.coalesce(sum_, quick)}).where("key is not null and size_bytes is not null")
    g = keyed.groupBy("size_bytes", "key_kind", "key").agg(F.count("*").alias("n"), F.min("rel_path").alias("first_path")).where("n > 1")
    return g.withColumns({"verified": F.col("key_kind") == "checksum", "wasted_bytes": F.col("size_bytes") * (F.col("n") - 1)})


def compare_sets(old: DataFrame, new: DataFrame, key: str, *columns: str) -> DataFrame:
    """Full outer comparison: new, removed, changed or same, null-safe in all columns."""
    a = old.select(key, F.struct(*columns).alias("a"))
    b = new.select(key, F.struct(*columns).alias("b"))
    status = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed")
    return a.join(b, key, "full").select(key, status.alias("status"))


def orphans_and_dead(live: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: ``orphan`` lives without record, ``dead`` is recorded without file."""
    a = live.select(key).distinct().join(recorded.select(key).distinct(), key, "left_anti").withColumn("kind", F.lit("orphan"))
    b = recorded.select(key).distinct().join(live.select(key).distinct(), key, "left_anti").withColumn("kind", F.lit("dead"))
    return a.unionByName(b)


def growth(held: DataFrame) -> DataFrame:
    """Bytes and files of each snapshot and their change since the one before it of the same root."""
    per = held.groupBy("root", "seq", "sid").agg(F.coalesce(F.sum(F.greatest("size", F.lit(0))), F.lit(0)).alias("bytes"), F.count("*").alias("files"))
    w = Window.partitionBy("root").orderBy("seq")
    return per.withColumns({"bytes_delta": F.col("bytes") - F.lag("bytes").over(w), "files_delta": F.col("files") - F.lag("files").over(w)})


def file_history(held: DataFrame) -> DataFrame:
    """CREATED, MODIFIED, UNCHANGED per present file and DELETED where it vanishes, along its root's snapshots."""
    w = Window.partitionBy("root", "path").orderBy("seq")
    x = held.withColumns({"p_seq": F.lag("seq").over(w), "p_size": F.lag("size").over(w), "p_m": F.lag("mtime_at").over(w), "n_seq": F.lead("seq").over(w)})
    follows = F.coalesce(F.col("p_seq") == F.col("seq") - 1, F.lit(False))
    same = F.col("size").eqNullSafe(F.col("p_size")) & F.col("mtime_at").eqNullSafe(F.col("p_m"))
    here = F.when(~follows, "CREATED").when(same, "UNCHANGED").otherwise("MODIFIED")
    gone = F.col("next_sid").isNotNull() & ~F.coalesce(F.col("n_seq") == F.col("seq") + 1, F.lit(False))
    states = F.array_compact(F.array(F.struct(F.col("sid"), here.alias("state")), F.when(gone, F.struct(F.col("next_sid").alias("sid"), F.lit("DELETED").alias("state")))))
    return x.select("root", "path", F.explode(states).alias("s")).select("root", "path", "s.sid", "s.state")


def ancestor_rollup(files: DataFrame) -> DataFrame:
    """Files, bytes and newest time of every directory's whole subtree: each file is sent to its ancestors and summed map-side."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    rows = files.select("sid", F.explode(up).alias("dir"), "size", "mtime_at")
    return rows.groupBy("sid", "dir").agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"), F.max("mtime_at").alias("newest"))


def directory_fingerprints(files: DataFrame) -> DataFrame:
    """Order-free hash of each directory's direct entries."""
    d = F.regexp_replace("path", "/?[^/]+$", "")
    return files.groupBy("sid", d.alias("dir")).agg(F.count("*").alias("n"), row_sum("path", "size", "mtime_at").alias("fingerprint"))


def recursive_hashes(files: DataFrame, levels: int = 64) -> DataFrame:
    """(sid, dir, n_entries, hash): hash of a directory from the sorted hashes of its entries, deepest level first.

    Every level is one aggregation over the directories of that depth; files and folders below
    ``levels`` are not expected in an inventory and raise no error, they only end the climb late.
    """
    entry = F.md5(F.concat_ws("\x1f", "name", F.coalesce(F.col("size").cast("string"), F.lit("")), F.coalesce("sum", F.lit(""))))
    parts = F.split("path", "/")
    rows = files.select("sid", F.slice(parts, F.lit(1), F.size(parts) - 1).alias("up"), F.element_at(parts, -1).alias("name"), "size", "sum").select("sid", "up", F.struct("name", entry.alias("hash")).alias("e"))
    rows = stored(rows)
    depth = min(levels, rows.agg(F.coalesce(F.max(F.size("up")), F.lit(0)).alias("d")).first()["d"])
    done, below = None, None
    for d in range(depth, -1, -1):
        here = rows.where(F.size("up") == d).select("sid", "up", "e")
        if below is not None:
            here = here.unionByName(below)
        dirs = here.groupBy("sid", "up").agg(F.count("*").alias("n_entries"), F.md5(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\x1f", "e.name", "e.hash"))), "\x1e")).alias("hash"))
        dirs = stored(dirs)
        done = dirs if done is None else done.unionByName(dirs)
        if d:
            below = dirs.select("sid", F.slice("up", F.lit(1), F.lit(d - 1)).alias("up"), F.struct(F.element_at("up", -1).alias("name"), "hash").alias("e"))
    return done.select("sid", F.array_join("up", "/").alias("dir"), "n_entries", "hash")


def disk_hotspots(files: DataFrame, k: int = 50) -> DataFrame:
    """The k largest and the k oldest files."""
    largest = files.orderBy(F.desc("size"), "sid", "path").limit(k).select(F.lit("largest").alias("kind"), "sid", "path", "size")
    oldest = files.where("mtime_at is not null").orderBy(F.col("mtime_at").cast("bigint"), "sid", "path").limit(k).select(F.lit("oldest").alias("kind"), "sid", "path", "size")
    return largest.unionByName(oldest)


def spans(chunks: DataFrame, k: int = 30) -> DataFrame:
    """Files by number of chunks and span of lines."""
    g = chunks.groupBy("path").agg(F.count("*").alias("n_chunks"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"), F.min("repo_id").alias("a"), F.max("repo_id").alias("b"))
    g = g.withColumn("repo_id", F.when(F.col("a") == F.col("b"), F.col("a")))
    return g.orderBy(F.desc("n_chunks"), F.desc(F.col("last_line") - F.col("first_line")), "repo_id", "path").limit(k).select("path", "repo_id", "n_chunks", "first_line", "last_line")
