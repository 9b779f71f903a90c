"""p1 at size: what the tables between the steps hold must not grow faster than the texts."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import history

SCHEMA = "chunk_id string, content_sha256 string, batch_no int, content string"


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def index(spark, rows, partitions: int = 1):
    return history.index_rows(history._contents(spark.createDataFrame(rows, SCHEMA).repartition(partitions))).cache()


def test_blocks_of_many_ranges_stay_small(spark):
    """With more ranges than records of a text, a record pays for the text's entry alone."""
    rows = index(spark, [(f"c{k}", None, k % 4, " ".join(words(k, 60))) for k in range(200)])
    b = history.blocks(rows, 5000, lambda b: history.segments_of(b, 8, True, 0), True)
    size = sum(F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in b.dtypes if kind == "binary")
    total = b.agg(F.sum(size)).first()[0]
    assert total <= 22 * 150 * 53


def test_copies_meet_once(spark):
    base = words(1, 60)
    near = base[:30] + ["x"] + base[31:]
    rows = index(spark, [(f"a{k}", None, 0, " ".join(base)) for k in range(20)] + [(f"b{k}", None, 1, " ".join(near)) for k in range(20)], 8)
    of = lambda probe: history.blocks(rows, 1, lambda b: history.segments_of(b, 8, probe, 0), probe)
    met = history.met(of(False), of(True), 1, 0.6)
    assert met.where(F.col("kind") == history.STORED).count() == 1


def test_texts_that_merely_share_sequences_are_no_pairs(spark):
    """40 texts of one phrase and own words, long ones too: all share sequences, two are near."""
    phrase = words(0, 30)
    texts = [words(k, 50 + 10 * (k % 40)) + phrase for k in range(1, 41)]
    texts += [[*texts[39][:20], "y", *texts[39][21:]], [*texts[38][:20], "y", *texts[38][21:]]]
    rows = index(spark, [(f"c{k}", None, k, " ".join(t)) for k, t in enumerate(texts)], 3)
    sides = rows.select("cid", F.lit(True).alias("as_stored"), F.lit(True).alias("as_probe"))
    pairs = {(r.sid, r.m_sid) for r in history._prefix_pairs(sides, rows, 0.6).collect()}
    short = {r.batch: r.cid & 0xFFFFFFFF for r in rows.collect()}
    assert {(short[40], short[39]), (short[41], short[38])} <= pairs and len(pairs) <= 10


def test_folded_sketches_never_exceed_the_distance():
    r = np.random.default_rng(3)
    for n in (40, 150, 250, 600):
        a = r.integers(0, 2**63, n, dtype=np.uint64)
        b = a.copy()
        b[: n // 5] = r.integers(0, 2**63, n // 5, dtype=np.uint64)
        halves = []
        for x in (a, b):
            bits = (np.bincount((x >> np.uint64(17)).astype(np.int64) & 511, minlength=512) & 1).astype(np.uint8)
            w = np.packbits(bits).view(np.uint64)
            halves.append(np.r_[w[:4] ^ w[4:], w[4:] if n >= history.LONG else w[4:] * np.uint64(0)])
        odd = history._odd_at_least((halves[0] ^ halves[1])[None], np.array([n >= history.LONG]))[0]
        assert 0 < odd <= 2 * (n // 5)


def test_texts_with_few_hot_segments_are_met_by_the_others(spark):
    """A stored text with fewer hot segments than ``need`` is found though its hot one meets nothing."""
    phrase = words(0, 8)
    base = [phrase + words(k, 152) for k in range(1, 31)]
    rows = [(f"a{k}", None, 0, " ".join(t)) for k, t in enumerate(base)]
    rows += [(f"b{k}", None, 1, " ".join([*t[:40], *(x if i % 12 else f"new{k}x{i}" for i, x in enumerate(t[40:]))])) for k, t in enumerate(base)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.chunk_id for r in history.chunks_seen_before(df, hot=4, in_batch=4).collect()} == {f"b{k}" for k in range(30)}
