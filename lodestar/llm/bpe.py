"""Byte-level BPE inside the JVM.

Texts are cut into words (pieces) by the tokenizer's pattern. A higher-order fold merges the neighbours
of lowest rank, again and again, over the byte array of a word; the array holds token ids, and a literal
map leads from two neighbouring ids to the id (the rank) of both together. Beside the tokens of the
vocabulary a literal of bounded size holds the ids of the HOT most frequent words of a sample, folded
once; it saves work and changes no result. Of all other words each document's distinct ones are folded
once and put in by their number, so no text, word or list of ids is shuffled.

The literal maps are two flat arrays searched by hash, as a map value in Spark is searched from its
start and is built anew in every task. Defined cases: null and empty texts give the empty list; blank
texts are encoded as they are; a fold costs the square of a word's length, so words of LONG bytes and
more (the pattern ends words at every change of kind of character) take an equal heap merge in Python;
repeated rows of a document count once, of differing texts the greatest; rows with a null doc_id are one
document; decoding concatenates the ids' bytes.
"""

from __future__ import annotations

import base64
import heapq
import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..session import broadcast_if_small

# Fixed value: the published cutting pattern of the vocabulary, with Unicode blanks.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same alternatives with the frequent ones first: no two of those before the blanks begin alike, but for the apostrophe.
CUT = r"(?U) ?\p{L}+| ?\p{N}+|'(?:[sdmt]|re|ve|ll)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HOT, LONG = 1 << 13, 256
HOT_FROM = 8  # one document of so many is looked at for frequent words
ID_BITS = 24


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _longs(df: DataFrame, values: np.ndarray) -> Column:
    """A constant array of longs as one block of memory, which tasks read without building objects."""
    jvm, gateway = df.sparkSession._jvm, df.sparkSession.sparkContext._gateway
    block = gateway.new_array(jvm.long, len(values))
    jvm.java.nio.ByteBuffer.wrap(bytearray(values.astype(">i8").tobytes())).asLongBuffer().get(block)
    data = jvm.org.apache.spark.sql.catalyst.expressions.UnsafeArrayData.fromPrimitiveArray(block)
    kind = jvm.org.apache.spark.sql.types.DataType.fromDDL("array<bigint>")
    return Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(jvm.org.apache.spark.sql.catalyst.expressions.Literal(data, kind)))


@dataclass(frozen=True)
class LiteralMap:
    """A constant map to longs, searched in two places by the key's 64-bit hash (cuckoo hashing)."""

    hashes: Column
    values: Column
    bits: int

    def __call__(self, key: Column) -> Column:
        return self.at(F.xxhash64(key))

    def at(self, h: Column) -> Column:
        """Value of a key's hash, null if there is none."""
        mask = F.lit((1 << self.bits) - 1)
        one, two = h.bitwiseAND(mask).cast("int"), F.shiftrightunsigned(h, 24).bitwiseAND(mask).cast("int")
        return F.when(F.get(self.hashes, one) == h, F.get(self.values, one)).when(F.get(self.hashes, two) == h, F.get(self.values, two))


def literal_map(df: DataFrame, hashed: list[tuple[int, int]]) -> LiteralMap:
    """From (hash of the key, value) pairs, a bounded number; values are not negative."""
    bits = max(4, (2 * len(hashed)).bit_length() + 1)
    mask = (1 << bits) - 1
    places = lambda h: ((h & mask), ((h & 0xFFFFFFFFFFFFFFFF) >> 24) & mask)
    slots: dict[int, tuple[int, int]] = {}
    for item in hashed:
        at = places(item[0])[0]
        for _ in range(500):
            item_before, slots[at] = slots.get(at), item
            if item_before is None or item_before[0] == item[0]:
                break
            item = item_before
            one, two = places(item[0])
            at = two if at == one else one
        else:
            raise ValueError("the keys do not fit; raise the number of bits")
    hashes, values = np.zeros(1 << bits, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int64)
    for at, (h, v) in slots.items():
        hashes[at], values[at] = h, v
    return LiteralMap(_longs(df, hashes), _longs(df, values), bits)


def _hash(value: bytes) -> int:
    """``xxhash64`` of Spark, signed."""
    v = xxhash.xxh64_intdigest(value, 42)
    return v - (1 << 64) if v >> 63 else v


def pair_literal(df: DataFrame, ranks: dict[bytes, int]) -> LiteralMap:
    """The rank of each two tokens that together are a token, by both ids: at most one entry for each cut of a token."""
    both = ((ranks[t[:i]] << ID_BITS | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
    return literal_map(df, [(_hash(k.to_bytes(8, "little")), r) for k, r in both])


def fold(latin: Column, ranks: dict[bytes, int], pairs: LiteralMap) -> Column:
    """Ids of one word, a byte to a character: merge the leftmost neighbours of lowest rank until none has a rank."""
    of_byte = F.array(*[F.lit(ranks[bytes([i])]).cast("long") for i in range(256)])
    ids = F.transform(F.filter(F.split(latin, ""), lambda c: c != ""), lambda c: F.get(of_byte, F.ascii(c)))

    def merge(t: Column, _: Column) -> Column:
        hashes = F.transform(t, lambda x, i: F.xxhash64(F.shiftleft(x, ID_BITS).bitwiseOR(F.get(t, i + 1))))

        def lowest(r: Column) -> Column:
            least = F.array_min(r)
            at = F.array_position(r, least).cast("int")
            return F.when(at > 0, F.concat(F.slice(t, F.lit(1), at - 1), F.array(least), F.slice(t, at + 2, F.size(t)))).otherwise(t)

        # a one-element array binds the ranks, so that they are looked up once
        return F.when(F.size(t) < 2, t).otherwise(F.get(F.transform(F.array(F.transform(hashes, pairs.at)), lowest), F.lit(0)))

    rounds = F.sequence(F.lit(1), F.greatest(F.length(latin) - 1, F.lit(1)))
    return F.transform(F.aggregate(rounds, ids, merge), lambda x: x.cast("int"))


def heap_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges in n log n, for pieces of any length."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, prev, nxt = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def push(i: int) -> None:
        j = nxt[i]
        if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n):
        push(i)
    while heap:
        _, i, e = heapq.heappop(heap)
        if not alive[i] or nxt[i] >= n or end[nxt[i]] != e:
            continue
        j = nxt[i]
        alive[j] = False
        end[i], nxt[i] = e, nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
        push(i)
        if prev[i] >= 0:
            push(prev[i])
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CUT), 0)


def _latin(word: Column) -> Column:
    return F.decode(F.encode(word, "utf-8"), "ISO-8859-1")


def hot_words(documents: DataFrame) -> DataFrame:
    """The most frequent words of a sample."""
    sample = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(HOT_FROM)) == 0)
    words = sample.select(F.explode(pieces(F.col("text"))).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    return words.where(F.octet_length("p") < LONG).orderBy(F.desc("n"), "p").limit(HOT)


def word_literals(documents: DataFrame, ranks: dict[bytes, int], pairs: LiteralMap) -> tuple[LiteralMap, Column]:
    """Words of known ids: the id of a token, the place in the second literal of the ids of a frequent word."""
    tokens = {_hash(t): r for t, r in ranks.items()}
    hot = hot_words(documents).repartition(8, "p").select(F.xxhash64("p").alias("h"), fold(_latin(F.col("p")), ranks, pairs).alias("ids")).collect()
    hot = [(r["h"], list(r["ids"])) for r in hot if r["h"] not in tokens]
    ends = np.cumsum([0, *(len(v) for _, v in hot)])
    runs = [(h, (int(ends[i]) + 1) << ID_BITS | int(ends[i + 1]) - 1) for i, (h, _) in enumerate(hot)]
    return literal_map(documents, [*tokens.items(), *runs]), _longs(documents, np.array([x for _, v in hot for x in v] or [0], dtype=np.int64))


def _once(documents: DataFrame) -> DataFrame:
    """One row per document; only the texts of keys that come more than once are shuffled."""
    docs = documents.select("doc_id", "text")
    many = broadcast_if_small(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    same = lambda d: docs.alias("d").join(many.alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")), d).select("d.*")
    return same("left_anti").unionByName(same("left_semi").groupBy("doc_id").agg(F.max("text").alias("text")))


def encode(documents: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, ids) of every document."""
    pairs = pair_literal(documents, ranks)
    places, flat = word_literals(documents.select("doc_id", "text"), ranks, pairs)
    shared = documents.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf(ArrayType(ArrayType(IntegerType())))
    def merged(rows: pd.Series) -> pd.Series:
        return rows.map(lambda words: [heap_merge(w.encode(), shared.value) for w in words])

    def ids_of(p: Column, v: Column) -> Column:
        """Ids of one word: read by its place, or those of the document's own word."""
        run = F.sequence(F.shiftright(v, ID_BITS) - 1, v.bitwiseAND(F.lit((1 << ID_BITS) - 1)))
        own = F.get("put", F.array_position("own", p).cast("int") - 1)
        return F.when(v < 1 << ID_BITS, F.array(v.cast("int"))).when(v.isNull(), own).otherwise(F.transform(run, lambda i: F.get(flat, i.cast("int")).cast("int")))

    cut = _once(documents).select("doc_id", pieces(F.col("text")).alias("ps"))
    cut = cut.withColumn("vs", F.transform(F.transform("ps", lambda p: F.xxhash64(p)), places.at))
    cut = cut.withColumn("own", F.array_distinct(F.filter("ps", lambda p, i: F.get("vs", i).isNull())))
    cut = cut.withColumn("long", F.filter("own", lambda p: F.octet_length(p) >= LONG)).withColumn("merged", merged("long"))
    of_long = lambda p: F.get("merged", F.array_position("long", p).cast("int") - 1)
    put = cut.withColumn("put", F.transform("own", lambda p: F.when(F.octet_length(p) < LONG, fold(_latin(p), ranks, pairs)).otherwise(of_long(p))))
    # ``put`` is named twice, so that it is computed once and not for every word
    return put.select("doc_id", F.when(F.size("put") >= 0, F.flatten(F.zip_with("ps", "vs", ids_of))).alias("ids"))


def decode(ids: Column, ranks: dict[bytes, int], df: DataFrame) -> Column:
    """Bytes of a list of ids: the tokens' pieces one after the other."""
    tokens = df.sparkSession.createDataFrame(pd.DataFrame({"v": list(ranks.values()), "k": [base64.b64encode(t).decode() for t in ranks]}), "v int, k string")
    rows = [r["k"] for r in tokens.orderBy("v").toLocalIterator()]
    table = F.from_json(F.lit(json.dumps(rows)), F.lit("array<string>"))
    return F.aggregate(ids, F.lit(b""), lambda acc, i: F.concat(acc, F.unbase64(F.get(table, i))))
