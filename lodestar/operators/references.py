"""References to records that do not exist: direct orphans and the records below them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normal
from ..session import checkpoint


@dataclass(frozen=True)
class ForeignKey:
    child: str
    field: str
    parent: str


KEYS = {"machines": "machine_id", "roots": "root_id", "snapshots": "snapshot_id", "deltas": "delta_id"}
FOREIGN_KEYS = (
    ForeignKey("roots", "machine_id", "machines"),
    ForeignKey("snapshots", "root_id", "roots"),
    ForeignKey("deltas", "from_snapshot_id", "snapshots"),
    ForeignKey("deltas", "to_snapshot_id", "snapshots"),
)


def _parents(df: DataFrame, key: str) -> DataFrame:
    deleted = F.col("deleted_at") if "deleted_at" in df.columns else F.lit(None).cast("timestamp_ntz")
    return df.select(normal.key(key).alias("p_key"), F.col("ingested_at").alias("p_from"), deleted.alias("p_to")).where("p_key is not null and p_from is not null").distinct()


def _references(df: DataFrame, fk: ForeignKey, key: str) -> DataFrame:
    return df.select(
        F.lit(fk.child).alias("child_table"),
        F.col(key).alias("child_key"),
        F.lit(fk.field).alias("ref_field"),
        normal.key(fk.field).alias("ref_key"),
        "ingested_at",
    ).where("ref_key is not null").distinct()


def direct_orphans(child: DataFrame, parent: DataFrame, fk: ForeignKey, keys: Mapping[str, str]) -> DataFrame:
    """References without a parent row that had arrived and was not deleted when the child arrived."""
    refs, live = _references(child, fk, keys[fk.child]), _parents(parent, keys[fk.parent])
    alive = (F.col("p_key") == F.col("ref_key")) & (F.col("p_from") <= F.col("ingested_at")) & (F.col("p_to").isNull() | (F.col("p_to") > F.col("ingested_at")))
    return refs.join(live, alive, "left_anti")


def _levels(fks: Sequence[ForeignKey]) -> list[str] | None:
    """Tables with parents before children; None if the graph has a cycle."""
    names = {t for fk in fks for t in (fk.child, fk.parent)}
    order: list[str] = []
    while names:
        ready = sorted(t for t in names if not any(fk.child == t and fk.parent in names for fk in fks))
        if not ready:
            return None
        order += ready
        names -= set(ready)
    return order


def orphan_cascade(tables: Mapping[str, DataFrame], fks: Sequence[ForeignKey] = FOREIGN_KEYS, keys: Mapping[str, str] = KEYS) -> DataFrame:
    """Direct and inherited orphan references.

    Columns: child_table, child_key, ref_field, ref_key, ingested_at, orphan_kind. A reference is
    ``direct`` if its own parent is missing and ``inherited`` if the parent row lives but is, or stands
    below, an orphan. The fixpoint goes down the foreign-key graph by semi-joins: an acyclic graph is
    unrolled in order of its levels inside one plan, a cyclic one is iterated, with a checkpoint per
    round, until no round adds a record. Null references are none; a child without ingested_at has no
    living parent; empty tables give no rows.
    """
    directs = {fk: direct_orphans(tables[fk.child], tables[fk.parent], fk, keys) for fk in fks}
    out = [d.withColumn("orphan_kind", F.lit("direct")) for d in directs.values()]
    refs = {fk: _references(tables[fk.child], fk, keys[fk.child]).join(directs[fk].select("child_key", "ref_key"), ["child_key", "ref_key"], "left_anti") for fk in fks}

    def bad_keys(name: str, rows: list[DataFrame]) -> DataFrame | None:
        parts = [r.select(normal.key("child_key").alias("bad")) for r in rows]
        if not parts:
            return None
        acc = parts[0]
        for p in parts[1:]:
            acc = acc.unionByName(p)
        return acc.where("bad is not null").distinct()

    order = _levels(fks)
    if order is not None:
        orphaned: dict[str, list[DataFrame]] = {t: [directs[fk] for fk in fks if fk.child == t] for t in order}
        for t in order:
            for fk in (fk for fk in fks if fk.child == t):
                bad = bad_keys(fk.parent, orphaned[fk.parent])
                if bad is not None:
                    below = refs[fk].join(bad, F.col("ref_key") == F.col("bad"), "left_semi")
                    orphaned[t] = [*orphaned[t], below]
                    out.append(below.withColumn("orphan_kind", F.lit("inherited")))
    else:
        reached = None
        frontier = None
        for d in directs.values():
            f = d.select("child_table", normal.key("child_key").alias("bad"))
            frontier = f if frontier is None else frontier.unionByName(f)
        frontier = checkpoint(frontier.where("bad is not null").distinct())
        reached, found = frontier, None
        while not frontier.isEmpty():
            step = None
            for fk in fks:
                bad = frontier.where(F.col("child_table") == fk.parent).select("bad")
                below = refs[fk].join(bad, F.col("ref_key") == F.col("bad"), "left_semi")
                step = below if step is None else step.unionByName(below)
            step = checkpoint(step)
            found = step if found is None else found.unionByName(step)
            fresh = step.select("child_table", normal.key("child_key").alias("bad")).where("bad is not null").distinct()
            frontier = checkpoint(fresh.join(reached, ["child_table", "bad"], "left_anti"))
            reached = checkpoint(reached.unionByName(frontier))
        if found is not None:
            out.append(found.distinct().withColumn("orphan_kind", F.lit("inherited")))
    acc = out[0]
    for d in out[1:]:
        acc = acc.unionByName(d)
    return acc


def orphan_report(cascade: DataFrame) -> DataFrame:
    """Count per table, field, kind and month of arrival."""
    return (
        cascade.withColumn("period", F.date_format("ingested_at", "yyyy-MM"))
        .groupBy("child_table", "ref_field", "orphan_kind", "period")
        .agg(F.count("*").alias("n_references"), F.count_distinct("child_key").alias("n_children"))
    )
