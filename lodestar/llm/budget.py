"""Token budget: exact longest-match counts by a trie with failure links, then totals.

The vocabulary is any set of byte strings that holds all single bytes. Every trie node carries the
node to go on from when no child fits (its failure link) and how many tokens are final by then
(precomputed emissions), so a piece is counted in one pass over its bytes, without going back.

Defined cases: null contents have no count; their tokens are estimated from size_bytes by the
bytes per token of their language, or of all, in a column of their own; empty contents have none;
a null size counts as zero bytes; repeated chunk rows count once; null languages, layers and tags
are groups of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normal

PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


class LongestMatch:
    """Counts the tokens of a left-to-right longest-match cut of a byte string in linear time."""

    def __init__(self, vocabulary: Iterable[bytes]) -> None:
        child: list[dict[int, int]] = [{}]
        final = [False]
        for token in vocabulary:
            u = 0
            for b in token:
                v = child[u].get(b)
                if v is None:
                    v = child[u][b] = len(child)
                    child.append({})
                    final.append(False)
                u = v
            final[u] = True
        if not all(b in child[0] and final[child[0][b]] for b in range(256)):
            raise ValueError("the vocabulary must hold all single bytes")
        fail, emit = [0] * len(child), [0] * len(child)
        queue = [0]
        for u in queue:
            for b, v in child[u].items():
                if final[v]:
                    fail[v], emit[v] = 0, 1
                else:
                    z, n = fail[u], emit[u]
                    while b not in child[z]:
                        n += emit[z]
                        z = fail[z]
                    fail[v], emit[v] = child[z][b], n
                queue.append(v)
        self._child, self._fail, self._emit = child, fail, emit

    def count(self, data: bytes) -> int:
        child, fail, emit = self._child, self._fail, self._emit
        u = n = 0
        for b in data:
            v = child[u].get(b)
            while v is None:
                n += emit[u]
                u = fail[u]
                v = child[u].get(b)
            u = v
        while u:
            n += emit[u]
            u = fail[u]
        return n


class PieceCounts(dict):
    """Counts by piece; forgets all beyond a bound of entries, keeps no very long piece."""

    def __init__(self, matcher: LongestMatch) -> None:
        self._matcher = matcher

    def __missing__(self, piece: str) -> int:
        n = self._matcher.count(piece.encode("utf-8", "surrogatepass"))
        if len(piece) < 256:
            if len(self) > 1_000_000:
                self.clear()
            self[piece] = n
        return n


_MATCHERS: dict[str, LongestMatch] = {}


def matcher(name: str, tokens: Iterable[bytes]) -> LongestMatch:
    """The matcher of a vocabulary, built once per process."""
    if name not in _MATCHERS:
        _MATCHERS[name] = LongestMatch(tokens)
    return _MATCHERS[name]


def token_counts(chunks: DataFrame, vocabulary: str) -> DataFrame:
    """One row per chunk: its columns but the content, and n_tokens (null for a null content).

    The file ``vocabulary`` is read by the driver; its tokens, a bounded number, are broadcast.
    """
    from .bpe import load_ranks

    tokens = chunks.sparkSession.sparkContext.broadcast(list(load_ranks(vocabulary)))
    keep = [c for c in chunks.columns if c != "content"]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        look = PieceCounts(matcher(vocabulary, tokens.value)).__getitem__
        for b in batches:
            n = [None if t is None else sum(map(look, PIECES.findall(t))) for t in b["content"]]
            yield b.drop(columns="content").assign(n_tokens=pd.array(n, dtype="Int64"))

    schema = chunks.select(*keep).schema.add("n_tokens", "long")
    return chunks.mapInPandas(count, schema).distinct()


def token_budget(chunks: DataFrame, bundles: DataFrame, vocabulary: str) -> DataFrame:
    """Totals per repo_id, language, layer and the repository's tags.

    ``chunks``: chunk_id, repo_id, language, layer, size_bytes, content. Columns: n_chunks, n_bytes,
    n_tokens (counted) and n_estimated (for null contents).
    """
    rows = token_counts(chunks.withColumn("language", F.nullif(normal.key("language"), F.lit(""))), vocabulary)
    part = rows.groupBy("repo_id", "language", "layer").agg(
        F.count("*").alias("n_chunks"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("n_bytes"),
        F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.sum(F.when(F.col("n_tokens").isNotNull(), F.col("size_bytes"))), F.lit(0)).alias("counted_bytes"),
        F.coalesce(F.sum(F.when(F.col("n_tokens").isNull(), F.col("size_bytes"))), F.lit(0)).alias("other_bytes"),
    )
    total = part.agg(F.sum("n_tokens").alias("t"), F.sum("counted_bytes").alias("c")).select(F.try_divide("t", "c").alias("all_rate"))
    rate = part.groupBy(F.col("language").alias("lang")).agg(F.try_divide(F.sum("n_tokens"), F.sum("counted_bytes")).alias("rate"))
    tags = bundles.groupBy(F.col("repo_id").alias("r")).agg(F.max(F.array_join(F.array_sort("tags"), ",")).alias("tags"))
    out = part.join(rate, F.col("language").eqNullSafe(F.col("lang")), "left").join(tags, F.col("repo_id") == F.col("r"), "left")
    out = out.withColumn("all_rate", total.scalar())
    est = F.ceil(F.col("other_bytes") * F.coalesce("rate", "all_rate", F.lit(0.0))).cast("long")
    return out.select("repo_id", "language", "layer", "tags", "n_chunks", "n_bytes", "n_tokens", est.alias("n_estimated"))


def domain_budget(budget: DataFrame) -> DataFrame:
    """Totals per tag; a repository counts in each of its tags."""
    rows = budget.withColumn("tag", F.explode_outer(F.split("tags", ",")))
    return rows.groupBy("tag", "language").agg(*[F.sum(c).alias(c) for c in ("n_chunks", "n_bytes", "n_tokens", "n_estimated")])
