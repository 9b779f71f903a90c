"""Full snapshots: derive the changes between consecutive ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normal
from ..session import broadcast_if_small


def complete_sequence(snapshots: DataFrame) -> DataFrame:
    """Complete snapshots in their order per root.

    One row per snapshot: ``sid`` (normal key), ``root``, ``created_at``, ``seq`` (from 1),
    ``next_sid`` (null for the last). Rows without root, key or created_at have no place in
    a sequence and are left out; of several complete rows of a key the last ingested holds.
    """
    rows = snapshots.where(normal.key("status") == "complete").select(
        normal.key("snapshot_id").alias("sid"), normal.key("root_id").alias("root"), "created_at", "ingested_at"
    )
    rows = rows.where("sid is not null and root is not null and created_at is not null")
    one = rows.groupBy("sid").agg(F.max(F.struct("ingested_at", "created_at", "root")).alias("r"))
    one = one.select("sid", "r.root", "r.created_at")
    w = Window.partitionBy("root").orderBy("created_at", "sid")
    return one.withColumns({"seq": F.row_number().over(w), "next_sid": F.lead("sid").over(w)})


def held_rows(files: DataFrame, sequence: DataFrame, *extra: str) -> DataFrame:
    """The inventory row that holds for each (root, snapshot, path), range-partitioned by (root, path).

    The ranges are by (root, path), so one root with a third of all rows is cut like any
    other stretch of keys. The sequence of snapshots is broadcast if a count proves it small,
    so that the inventory is shuffled once. Rows without path are left out.
    """
    f = files.select(
        normal.key("snapshot_id").alias("sid"),
        normal.rel_path("rel_path").alias("path"),
        F.col("size_bytes").alias("size"),
        F.coalesce(normal.instant("mtime").cast("string"), F.trim("mtime")).alias("mtime_at"),
        "ingested_at",
        "entry_id",
        *extra,
    ).where("path is not null and path <> ''")
    joined = f.join(broadcast_if_small(sequence), "sid").repartitionByRange("root", "path")
    value = F.struct("ingested_at", "entry_id", "size", "mtime_at", *extra)
    held = joined.groupBy("root", "path", "seq", "sid", "created_at", "next_sid").agg(F.max(value).alias("v"))
    return held.select("root", "path", "seq", "sid", "created_at", "next_sid", "v.*")


def snapshot_changes(files: DataFrame, snapshots: DataFrame, *extra: str) -> DataFrame:
    """Added, removed and changed paths from each complete snapshot to the next of its root.

    Within a range the rows lie sorted by (root, path, seq); neighbouring rows are merged like
    two sorted lists: a gap before a row is an addition, a gap after it a removal, no gap a
    comparison of size and instant of mtime (null-safe). Columns: snapshot_id (the later one),
    rel_path, change_kind, entry_id (of the added or changed row, null for removals), size, created_at, ``extra``.
    """
    held = held_rows(files, complete_sequence(snapshots), *extra)
    w = Window.partitionBy("root", "path").orderBy("seq")
    prev = lambda c: F.lag(c).over(w)
    row = held.withColumns({"p_seq": prev("seq"), "p_size": prev("size"), "p_mtime": prev("mtime_at"), "n_seq": F.lead("seq").over(w)})
    same = F.col("size").eqNullSafe(F.col("p_size")) & F.col("mtime_at").eqNullSafe(F.col("p_mtime"))
    follows = F.coalesce(F.col("p_seq") == F.col("seq") - 1, F.lit(False))
    now = F.when((F.col("seq") > 1) & ~follows, F.lit("added")).when(follows & ~same, F.lit("changed"))
    gone = F.when(F.col("next_sid").isNotNull() & ~F.coalesce(F.col("n_seq") == F.col("seq") + 1, F.lit(False)), F.lit("removed"))
    events = F.array_compact(
        F.array(
            F.when(now.isNotNull(), F.struct(F.col("sid").alias("snapshot_id"), now.alias("change_kind"), F.col("entry_id").alias("entry_id"))),
            F.when(gone.isNotNull(), F.struct(F.col("next_sid").alias("snapshot_id"), gone.alias("change_kind"), F.lit(None).cast("bigint").alias("entry_id"))),
        )
    )
    out = row.select("path", "size", "created_at", *extra, F.explode(events).alias("e"))
    return out.select("e.snapshot_id", F.col("path").alias("rel_path"), "e.change_kind", "e.entry_id", "size", "created_at", *extra)
