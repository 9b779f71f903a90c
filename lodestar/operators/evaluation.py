"""Measures of ranked results and of matched record sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _measures(k: int) -> list[Column]:
    return [
        F.count("*").alias("n_queries"),
        F.round(F.avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)) * 100, 6).alias("recall_at_k"),
        F.round(F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr"),
    ]


def recall_mrr(ranks: DataFrame, k: int) -> DataFrame:
    """Recall at k in per cent, mean reciprocal rank and share of queries without any hit."""
    zero = F.round(F.avg(F.when(F.col("first_rank").isNull(), 1.0).otherwise(0.0)), 6)
    return ranks.agg(*_measures(k), zero.alias("zero_hit_ratio"))


def recall_by_groups(ranks: DataFrame, k: int) -> DataFrame:
    """The same overall, per category and per language in one pass (grouping sets)."""
    sets = [[], [F.col("category")], [F.col("language")]]
    out = ranks.groupingSets(sets, F.col("category"), F.col("language")).agg(*_measures(k))
    return out.withColumns({c: F.coalesce(c, F.lit("(all)")) for c in ("category", "language")})


def miss_taxonomy(ranks: DataFrame, ranked: DataFrame, low: int = 3) -> DataFrame:
    """Queries per kind of outcome, first matching rule decides."""
    n = ranked.groupBy("query_id").agg(F.count("*").alias("n"))
    kind = (
        F.when(F.col("first_rank") <= low, "hit").when(F.col("first_rank").isNotNull(), "ranked_low").when(F.col("n").isNull(), "no_candidates").otherwise("not_ranked")
    )
    return ranks.join(n, "query_id", "left").groupBy(kind.alias("miss_type")).agg(F.count("*").alias("n_queries"))


def paired_improvement(values: DataFrame, base: str, new: str) -> DataFrame:
    """Means, gain and direction of two routes over the same cases, per category."""
    both = values.groupBy("query_id", "category").agg(F.max(F.when(F.col("route") == base, F.col("value"))).alias("a"), F.max(F.when(F.col("route") == new, F.col("value"))).alias("b"))
    return both.groupBy("category").agg(
        F.count("*").alias("n_pairs"), F.round(F.avg("a"), 6).alias("mean_base"), F.round(F.avg("b"), 6).alias("mean_new"), F.round(F.avg(F.col("b") - F.col("a")), 6).alias("mean_gain"),
        F.count_if(F.col("b") > F.col("a")).alias("n_better"), F.count_if(F.col("b") < F.col("a")).alias("n_worse"),
    )


def multiset_match(actual: DataFrame, expected: DataFrame, *keys: str) -> DataFrame:
    """True positives by grouped least(count, count), false positives and negatives, precision, recall."""
    a = actual.groupBy(*keys).agg(F.count("*").alias("n_a"))
    e = expected.groupBy(*keys).agg(F.count("*").alias("n_e"))
    both = a.join(e, list(keys), "full").select(F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_e", F.lit(0)).alias("n_e"))
    s = both.agg(F.sum(F.least("n_a", "n_e")).alias("tp"), F.sum("n_a").alias("a"), F.sum("n_e").alias("e"))
    return s.select("tp", (F.col("a") - F.col("tp")).alias("fp"), (F.col("e") - F.col("tp")).alias("fn"), F.round(F.try_divide("tp", "a"), 6).alias("precision"), F.round(F.try_divide("tp", "e"), 6).alias("recall"))


def nearest_rank(rows: DataFrame, group: str, value: str, share: float = 0.95) -> DataFrame:
    """Nearest-rank percentile: the element at round((n - 1) * share) in order.

    Positions come from a count per distinct value and its running sum, so no group is gathered
    in an array; values repeat far less often than rows.
    """
    from pyspark.sql import Window

    per = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(group)
    run = per.withColumns({"upto": F.sum("c").over(w.orderBy(value)), "n": F.sum("c").over(w)})
    at = F.round((F.col("n") - 1) * share).cast("long") + 1
    hit = run.where((F.col("upto") >= at) & (F.col("upto") - F.col("c") < at))
    return hit.select(group, F.col(value).alias("p"), "n")
