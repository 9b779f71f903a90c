"""Context under token and byte budgets."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, stored


def first_fit(candidates: DataFrame, request: str, budget: int) -> DataFrame:
    """First fit in the order (priority, tokens, id): what does not fit is passed over, later ones may still fit.

    Within a priority the items come by size, so once one does not fit no later one of it does: only the
    head of each priority whose running sum is within the budget can be taken. The heads, bounded by the
    budget, are folded as one sorted array in the JVM. Items without a size are never taken.
    """
    w = Window.partitionBy(request, "priority").orderBy("tokens", "id").rowsBetween(Window.unboundedPreceding, 0)
    candidates = candidates.where(F.col("tokens") <= budget).withColumn("_sum", F.sum("tokens").over(w)).where(F.col("_sum") <= budget).drop("_sum")
    items = F.array_sort(F.collect_list(F.struct("priority", "tokens", "id")))
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<string>").alias("ids"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["tokens"] <= budget
        return F.struct((acc["used"] + F.when(fits, x["tokens"]).otherwise(0)).alias("used"), F.when(fits, F.concat(acc["ids"], F.array(x["id"]))).otherwise(acc["ids"]).alias("ids"))

    chosen = candidates.groupBy(request).agg(F.aggregate(items, zero, step).alias("c"))
    return chosen.select(request, F.col("c.used").alias("used"), F.posexplode("c.ids").alias("pos", "id"))


def weighted_greedy(candidates: DataFrame, request: str, tokens: int, n_bytes: int, diversity: float = 0.1) -> DataFrame:
    """Repeatedly the best remaining item by relevance less a share per item already taken from its source.

    Ties go to fewer tokens, then to the greater id. Scores only fall, so a heap gives the best item and only what
    comes up with an outdated score is put back. Of items of one size at most as many as fill a budget are taken:
    one is left out before if so many others come before it in any case (with their score after all that may come
    first from their source), so a request's task holds a number of items that the budgets bound. Sizes are not
    negative; items without a size are never taken, those without a relevance come last.
    """
    if diversity < 0:
        raise ValueError("diversity must not be negative")
    low = F.lit(float("-inf"))
    c = candidates.where((F.col("tokens") <= tokens) & (F.col("bytes") <= n_bytes)).withColumn("relevance", F.coalesce(F.nanvl(F.col("relevance").cast("double"), low), low))
    fill = F.least(F.when(F.col("tokens") > 0, F.floor(F.lit(tokens) / F.col("tokens"))), F.when(F.col("bytes") > 0, F.floor(F.lit(n_bytes) / F.col("bytes"))))
    before = F.count(F.lit(1)).over(Window.partitionBy(request, "source").orderBy(F.round("relevance", 9).desc())) - 1
    c = c.withColumn("_least", F.col("relevance") - F.lit(float(diversity)) * before)
    same = Window.partitionBy(request, "tokens", "bytes")
    c = c.withColumn("_at", F.row_number().over(same.orderBy(F.col("_least").desc())))
    c = c.withColumn("_bar", F.max(F.when(F.col("_at") == fill, F.col("_least"))).over(same)).where("_bar is null or relevance >= _bar").drop("_least", "_at", "_bar")

    def pick(batch: pd.DataFrame) -> pd.DataFrame:
        b = batch.sort_values("id", ascending=False, ignore_index=True)
        relevance, sizes, n, source, ids = (b[x].tolist() for x in ("relevance", "tokens", "bytes", "source", "id"))
        heap = [(-r, t, i, 0) for i, (r, t) in enumerate(zip(relevance, sizes))]
        heapq.heapify(heap)
        used_t = used_b = 0
        taken: list[int] = []
        seen: dict[str, int] = {}
        while heap:
            _, t, i, scored = heapq.heappop(heap)
            if used_t + t > tokens or used_b + n[i] > n_bytes:
                continue
            now = seen.get(source[i], 0)
            if now != scored:
                heapq.heappush(heap, (-(relevance[i] - diversity * now), t, i, now))
                continue
            used_t, used_b = used_t + t, used_b + n[i]
            seen[source[i]] = now + 1
            taken.append(i)
        return pd.DataFrame({request: b[request].iloc[taken].to_numpy(), "pos": range(len(taken)), "id": [ids[i] for i in taken], "tokens": [sizes[i] for i in taken]}, columns=[request, "pos", "id", "tokens"])

    kind = candidates.schema[request].dataType.simpleString()
    return c.groupBy(request).applyInPandas(pick, f"{request} {kind}, pos int, id string, tokens long")


def running_before(rows: DataFrame, group: str, order: list[str], size: str) -> DataFrame:
    """Adds ``before``: the sum of ``size`` over the rows of the group that come earlier in a total order.

    Two levels, so that a group with a third of all rows is not one task: rows are cut into ranges of
    (group, order), each range sums up its own rows, and only the sums of the ranges run over the group.
    """
    ranges = stored(rows.repartitionByRange(F.col(group), *[F.col(o) for o in order]).withColumn("_range", F.spark_partition_id()))
    sums = ranges.groupBy(group, "_range").agg(F.sum(size).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col(group).alias("_group"), F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = ranges.withColumn("_own", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    x = x.join(broadcast_if_small(starts), F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_r")))
    return x.withColumn("before", F.col("_start") + F.col("_own")).drop("_range", "_r", "_group", "_start", "_own")


def split_by_size(rows: DataFrame, group: str, order: str, size: str, most: int) -> DataFrame:
    """Part number of each row when parts are cut by accumulated size."""
    return running_before(rows, group, [order], size).withColumn("part", F.floor(F.col("before") / most).cast("int") + 1).drop("before")
