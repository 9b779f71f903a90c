"""Evaluation texts inside training text: a prefix-filtered set join with exact verification.

An item leaks into a document if WINDOW (13) successive words of its passage stand there. Each such
window is a set of SHINGLE-word shingles that must all be in the document, so by the prefix principle
the first of them in any fixed order is a sufficient join key. The order is by rarity among the items'
own shingles: in how many items a shingle stands, then how often its rarest words stand in the items,
then its hash. Only these prefix shingles are looked for, in one scan of the documents. The place of the
shingle in the window bounds where the window begins in the document (position) and how many words must
follow (length); what fits is verified word by word on the spot, so no text is shuffled or read again.

The items are a stated query set against all documents: they go out in blocks of about BLOCK windows,
one scan each, so what is broadcast is bounded however many items there are.

Defined cases: null and short texts or passages match nothing; rows with a null key are left out; an
empty side gives no rows; repeated rows count once, and of two texts under one doc_id the one with more
windows of an item counts; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

WINDOW, SHINGLE = 13, 5
BLOCK = 100_000
WORDS = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits after NFC, without case."""
    if not text:
        return []
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return WORDS.findall(text.lower())


@F.pandas_udf(T.ArrayType(T.StringType()))
def words(texts: pd.Series) -> pd.Series:
    return texts.map(words_of)


def _runs(w: Column, size: int) -> Column:
    """All runs of ``size`` words by place; empty for a shorter text."""
    n = F.size(w) - size + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.slice(w, i, size))).otherwise(F.array().cast("array<array<string>>"))


def windows(items: DataFrame) -> DataFrame:
    """(item_id, w: the WINDOW words, off: place of the prefix shingle in them), once each."""
    p = items.where("item_id is not null").select("item_id", words(F.col("passage")).alias("pw")).distinct()
    often = p.select("item_id", F.explode("pw").alias("word")).groupBy("word").agg(F.count("*").alias("n_word"))
    shingles = p.select("item_id", F.explode(_runs(F.col("pw"), SHINGLE)).alias("s")).distinct()
    held = shingles.groupBy("s").agg(F.count("*").alias("n_items"))
    rarest = held.select("s", F.explode("s").alias("word")).join(often, "word").groupBy("s").agg(F.array_sort(F.collect_list("n_word")).alias("rare"))
    order = held.join(rarest, "s").select("s", F.struct("n_items", "rare", F.xxhash64("s").alias("h")).alias("rank"))
    cut = stored(p.select("item_id", F.explode(_runs(F.col("pw"), WINDOW)).alias("w")).distinct())
    parts = cut.select("w", F.posexplode(_runs(F.col("w"), SHINGLE)).alias("off", "s")).distinct().join(order, "s")
    prefix = parts.groupBy("w").agg(F.min(F.struct("rank", "off")).alias("p")).select("w", F.col("p.off").alias("off"))
    return cut.join(prefix, "w")


@dataclass(frozen=True)
class Block:
    """The windows of a bounded number of items, ready to be looked up by prefix shingle."""

    numbers: dict[str, int]  # word -> number, from 1
    keys: np.ndarray  # sorted prefix keys
    rows: np.ndarray  # the windows' words as numbers, in the order of ``keys``
    off: np.ndarray
    items: np.ndarray  # item ids of each window

    @classmethod
    def of(cls, wins: pd.DataFrame) -> Block:
        numbers: dict[str, int] = {}
        rows = np.array([[numbers.setdefault(x, len(numbers) + 1) for x in w] for w in wins["w"]], dtype=np.int64).reshape(-1, WINDOW)
        off = wins["off"].to_numpy(dtype=np.int64)
        keys = _mixed(rows[np.arange(len(rows))[:, None], off[:, None] + np.arange(SHINGLE)].T)
        by = np.argsort(keys, kind="stable")
        return cls(numbers, keys[by], rows[by], off[by], wins["item_id"].to_numpy(dtype=object)[by])

    def found(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, window) of each window that stands in a text, by number."""
        number, flat, ends = self.numbers.get, [], []
        for t in texts:
            flat.extend([number(w, 0) for w in words_of(t)])
            ends.append(len(flat))
        ids, end = np.array(flat, dtype=np.int64), np.array(ends, dtype=np.int64)
        if len(ids) < WINDOW or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        grams = _mixed([ids[i : len(ids) - SHINGLE + 1 + i] for i in range(SHINGLE)])
        low = np.searchsorted(self.keys, grams)
        at = np.flatnonzero(self.keys[np.minimum(low, len(self.keys) - 1)] == grams)
        low = low[at]
        n = np.searchsorted(self.keys, grams[at], side="right") - low
        place = np.repeat(at, n)
        win = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(place))
        text = np.searchsorted(end, place, side="right")
        begin = place - self.off[win]
        first = np.where(text > 0, end[text - 1], 0)
        fits = (begin >= first) & (begin + WINDOW <= end[text])
        text, win, begin = text[fits], win[fits], begin[fits]
        same = (ids[begin[:, None] + np.arange(WINDOW)] == self.rows[win]).all(1)
        return text[same], win[same]


def _mixed(columns: list[np.ndarray] | np.ndarray) -> np.ndarray:
    g = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        g = (g ^ c.astype(np.uint64)) * _MIX
        g ^= g >> np.uint64(29)
    return g


def contained_items(documents: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, n_windows): each document with each item it holds a window of."""
    spark = documents.sparkSession
    kinds = {f.name: f.dataType for f in [*documents.select("doc_id").schema, *items.select("item_id").schema]}
    schema = T.StructType([T.StructField(k, v) for k, v in kinds.items()] + [T.StructField("block", T.IntegerType()), T.StructField("n", T.LongType())])
    wins = stored(windows(items))
    docs = documents.where("doc_id is not null").select("doc_id", "text")
    parts = -(-wins.count() // block)
    found = spark.createDataFrame([], schema)
    for i in range(parts):
        rows = wins.where(F.pmod(F.xxhash64("w"), F.lit(parts)) == i).toPandas()
        found = found.unionByName(docs.mapInPandas(_scan(spark.sparkContext.broadcast(Block.of(rows)), i), schema))
    once = found.groupBy("doc_id", "item_id", "block").agg(F.max("n").alias("n"))
    return once.groupBy("doc_id", "item_id").agg(F.sum("n").alias("n_windows"))


def _scan(shared, number: int):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text, win = shared.value.found(b["text"].tolist())
            hits = pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[text], "item_id": shared.value.items[win], "w": win}).drop_duplicates()
            yield hits.groupby(["doc_id", "item_id"]).size().reset_index(name="n").assign(block=number)[["doc_id", "item_id", "block", "n"]]

    return scan
