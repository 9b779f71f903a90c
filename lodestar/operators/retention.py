"""Which records a store keeps: by age, number and bytes, and by recency and period."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def retention_plan(rows: DataFrame, kind: str, key: str, at: str, size: str, protected: str, as_of: str, max_age_days: int, max_count: int, max_bytes: int) -> DataFrame:
    """Unprotected rows to drop and why: over age first, then oldest over number, then oldest over bytes."""
    old = F.col(at) < F.to_timestamp_ntz(F.lit(as_of)) - F.expr(f"interval {max_age_days} days")
    drop_age = F.coalesce(old, F.lit(True)) & ~F.col(protected)
    base = rows.withColumn("_age", drop_age)
    left = base.where("not _age")
    every = Window.partitionBy(kind)
    oldest = Window.partitionBy(kind, protected).orderBy(F.asc_nulls_first(at), key)
    left = left.withColumns({"_n": F.count("*").over(every), "_bytes": F.sum(size).over(every), "_rn": F.row_number().over(oldest)})
    by_count = ~F.col(protected) & (F.col("_rn") <= F.col("_n") - max_count)
    left = left.withColumn("_count", by_count)
    rest = left.where("not _count").withColumn("_total", F.sum(size).over(every))
    before = F.coalesce(F.sum(size).over(oldest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = rest.withColumn("_bytes_drop", ~F.col(protected) & (before < F.col("_total") - max_bytes))
    out = base.where("_age").select(kind, key, F.lit("age").alias("reason"))
    out = out.unionByName(left.where("_count").select(kind, key, F.lit("count").alias("reason")))
    return out.unionByName(rest.where("_bytes_drop").select(kind, key, F.lit("bytes").alias("reason")))


def keep_newest(rows: DataFrame, group: str, at: str, key: str, n: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(at), F.desc(key))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def period_anchors(rows: DataFrame, group: str, at: str, key: str, n: int, days: int, weeks: int) -> DataFrame:
    """Kept rows with all their reasons: n newest, newest of each of the last days, newest of each of the last weeks."""
    newest = [F.desc(at), F.desc(key)]
    rn = lambda *p: F.row_number().over(Window.partitionBy(group, *p).orderBy(*newest))
    x = rows.withColumns({"_day": F.date_trunc("day", at), "_week": F.date_trunc("week", at)})
    x = x.withColumns({"_n": rn(), "_dn": rn("_day"), "_wn": rn("_week")})
    order = lambda c: F.dense_rank().over(Window.partitionBy(group).orderBy(F.desc(c)))
    x = x.withColumns({"_dr": order("_day"), "_wr": order("_week")})
    reasons = F.array_compact(F.array(F.when(F.col("_n") <= n, F.lit("recent")), F.when((F.col("_dn") == 1) & (F.col("_dr") <= days), F.lit("daily")), F.when((F.col("_wn") == 1) & (F.col("_wr") <= weeks), F.lit("weekly"))))
    return x.withColumn("reasons", F.array_join(reasons, ",")).where("reasons <> ''").select(group, key, "reasons")
