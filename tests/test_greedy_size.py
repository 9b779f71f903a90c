"""weighted_greedy against the plain search for the best item, and on more items than that search can take."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lodestar.operators import selection as S

SCHEMA = "r string, id string, source string, relevance double, tokens long, bytes long"


def plain(rows, tokens, n_bytes, diversity):
    left, used_t, used_b, taken, seen = list(rows), 0, 0, [], {}
    while left:
        best = max(left, key=lambda x: (x[3] - diversity * seen.get(x[2], 0), -x[4], x[1]))
        left.remove(best)
        if used_t + best[4] <= tokens and used_b + best[5] <= n_bytes:
            used_t, used_b = used_t + best[4], used_b + best[5]
            seen[best[2]] = seen.get(best[2], 0) + 1
            taken.append(best[1])
    return taken


def test_greedy_equals_plain_search(spark):
    r, rows = random.Random(4), []
    for k in range(12):
        for i in range(250):
            size = r.choice([0, 5, 8, 40, 41, 200, 999]) if i % 50 == 0 else r.choice([5, 8, 40, 41, 200, 999])
            rows.append((f"r{k}", f"i{i:03d}", r.choice("abcdefgh"[: 1 + k % 8]) if k < 10 else f"s{i}", r.randrange(100 if k % 2 else 4) / 100, -(-size // 4), size))
    for diversity in (0.1, 0.0):
        got = S.weighted_greedy(spark.createDataFrame(rows, SCHEMA), "r", 60, 260, diversity).orderBy("r", "pos").collect()
        for k in range(12):
            assert [x.id for x in got if x.r == f"r{k}"] == plain([x for x in rows if x[0] == f"r{k}"], 60, 260, diversity)


def test_greedy_of_many_items(spark):
    """200,000 items of one request: the plain search would compare 20,000,000,000 times."""
    d = spark.range(200_000).select(F.lit("r").alias("r"), F.col("id").cast("string").alias("id"), (F.col("id") % 50_000).cast("string").alias("source"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("relevance"), (1 + F.col("id") % 300).alias("tokens"), (4 + F.col("id") % 1200).alias("bytes"))
    got = S.weighted_greedy(d, "r", 2000, 9000).collect()
    assert 0 < sum(x.tokens for x in got) <= 2000


def test_greedy_without_size_or_relevance(spark):
    rows = [("r", "a", "s", None, 1, 1), ("r", "b", None, 0.5, 1, 1), ("r", "c", "t", 0.9, None, 1), ("r", "d", "t", 0.9, 1, None), (None, "e", "t", 0.1, 1, 1)]
    got = S.weighted_greedy(spark.createDataFrame(rows, SCHEMA), "r", 10, 10).orderBy("r", "pos").collect()
    assert [(x.r, x.id) for x in got] == [(None, "e"), ("r", "b"), ("r", "a")]
