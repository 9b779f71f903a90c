"""New batches against all history: a segment index for bounded edit distance.

Near means: of all distinct three-word sequences of two texts the share found in both is at least
``share``. That is a bound on an edit distance: with both texts written as their sorted distinct
sequences A and B, insertions plus deletions |A \\ B| + |B \\ A| may be at most
(1 - share) / (1 + share) * (|A| + |B|); ``verified`` counts exactly that, on 64-bit hashes.

Index. A text of L words is cut into L // size segments of ``size`` words at fixed, evenly spaced
places, so their number depends on the length alone. An inserted, deleted or replaced word costs at
least five sequences on both sides together, so a near pair has at most 2c|A| / (5 - c) places of
change, c = (1 - share) / (1 + share), and ``segment_words`` takes the largest size that leaves more
segments than that: one segment of the earlier text at least (``need``) stands unchanged in the later
one, wherever it has moved. A new batch therefore probes with its own substrings of ``size`` words; the
number of segments met, the lengths and a sketch bound what is verified. Stored segments and probes are kept as blocks: per Arrow batch and
hash range one row with sorted hashes and a small table of their texts, by bytes of equal rank (the more
ranges, the fewer records share a text's entry, so an entry is short: 32 bits of its number); copies of a text
are one text of a range, and a range is met by binary search. What shares a short number is told apart
afterwards. A batch is appended as its own rows and blocks; history is never built again.

Hot segments (more than HOT earlier texts, or IN_BATCH in one Arrow batch) would meet in squares. Every
text that has one is noted. It first meets only the earliest text of each hot segment, which ends a mass
of near copies at one row each. A stored text with fewer hot segments than ``need`` shares at least the
difference in others, and is met by those. What is still open meets the noted texts with ``need`` or more by
a prefix join: sequences in order of rarity among them (counted in a table of fixed size, which orders and
drops nothing), and of each text only the first |A| - ceil(share * |A|) + 1; two near texts share one of
these. There the blocks hold the sketches, so that only pairs within all bounds are written: the pairs that
merely share a sequence grow with the square of the texts. Texts with many repeated sequences, for which a
place of change may cost less, always go that way too. Nothing is dropped.

Defined cases: null content: only its digest decides; fewer than MIN_WORDS words: only equality;
repeated rows count once; null batch numbers are never earlier or later than anything; any further
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normal
from ..session import broadcast_if_small, stored

MIN_WORDS, SHARE = 40, 0.6
HOT, IN_BATCH = 64, 16
LONG = 200  # sequences from which on a folded sketch (256 bits) no longer tells texts apart
REPEATED = 0.2  # part of a text's sequences that repeat earlier ones, from which on the exact way is taken
BUCKET_RECORDS, PAIRS_AT_ONCE, SKETCHES_AT_ONCE = 2_500_000, 2_000_000, 300_000
WORDS = re.compile(r"\w+")
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_LOCAL, _KEY, _SLOT, _SHORT = np.uint64(24), np.uint64(40), np.uint64(46), 0xFFFFFFFF
SLOTS, PARTS = 1 << 18, 32
STORED, PROBE, HOT_KEY, HOT_STORED, HOT_PROBE = range(5)

ROWS = "cid long, batch int, n int, n_words int, need int, sketch array<long>, repeats boolean, words binary"
BLOCKS = "bucket int, kind int, keys binary, texts binary, sids binary, ns binary, needs binary, batches binary, sketches binary"
MET = "kind int, sid long, m_sid long, key long, hits int, need int"


class _WordIds(dict):
    """Stable 64-bit numbers of words; forgets all beyond a bound."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 2_000_000:
            self.clear()
        self[word] = v = xxhash.xxh64_intdigest(word)
        return v


def _grams(ids: np.ndarray, size: int) -> np.ndarray:
    n = max(0, len(ids) - size + 1)
    g = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        g = g * _MIX + ids[i : i + n]
    g ^= g >> np.uint64(29)
    g *= _MIX2
    g ^= g >> np.uint64(32)
    return g


def short_id(cid: Column) -> Column:
    return cid.bitwiseAND(F.lit(_SHORT))


def _planes(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of each value, all bytes of one rank together: equal ones compress."""
    return values.view(np.uint8).reshape(len(values), -1)[:, :width].T.tobytes()


def _from_planes(packed: bytes, width: int, kind: type) -> np.ndarray:
    planes = np.frombuffer(packed, dtype=np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], np.dtype(kind).itemsize), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view(kind).ravel()


def segment_words(share: float = SHARE, least: int = MIN_WORDS) -> int:
    """Largest segment size at which every length from ``least`` on has more segments than places of change."""
    n = np.arange(least, 40 * least)
    holds = lambda size: (n // size > places_of_change(n - 2, share)).all()
    return next((size for size in range(least, 2, -1) if holds(size)), 3)


def places_of_change(n: np.ndarray | int, share: float):
    """At how many places at most a text of ``n`` distinct sequences differs from a near one."""
    c = (1 - share) / (1 + share)
    return (np.asarray(n) * 2 * c / (5 - c) + 1e-9).astype(int)


def _contents(chunks: DataFrame) -> DataFrame:
    """Content class, batch and content of each chunk row; the class is the SHA-256 of the content, else its stated digest."""
    sha = F.coalesce(F.sha2(F.encode("content", "utf-8"), 256), normal.digest("content_sha256"))
    return chunks.select("chunk_id", sha.alias("sha"), F.col("batch_no").cast("int").alias("batch"), "content")


def index_rows(contents: DataFrame, share: float = SHARE) -> DataFrame:
    """One row per content of MIN_WORDS words or more: what a batch appends to the stored history.

    ``need``: how many of its different segments stand unchanged in a near text.
    """
    size = segment_words(share)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, seen = _WordIds(), set()
        look = ids.__getitem__
        for b in batches:
            if len(seen) > 1_000_000:
                seen.clear()
            out = []
            for cid, batch, content in zip(b["cid"].tolist(), b["batch"].tolist(), b["content"].tolist()):
                if (cid, batch) in seen:
                    continue
                seen.add((cid, batch))
                found = WORDS.findall(content.lower())
                if len(found) < MIN_WORDS:
                    continue
                w = np.fromiter(map(look, found), dtype=np.uint64, count=len(found))
                t = np.unique(_grams(w, 3))
                bits = np.bincount((t >> np.uint64(17)).astype(np.int64) & 511, minlength=512) & 1
                need = len(np.unique(_grams(w, size)[_begins(len(w), size)])) - int(places_of_change(len(t), share))
                repeats = need < 1 or len(t) < (1 - REPEATED) * (len(w) - 2)
                out.append((cid, batch, len(t), len(w), need, np.packbits(bits.astype(np.uint8)).view(np.int64), repeats, w.tobytes()))
            yield pd.DataFrame(out, columns=["cid", "batch", "n", "n_words", "need", "sketch", "repeats", "words"])

    rows = contents.where("content is not null and batch is not null").select(F.xxhash64("sha").alias("cid"), "batch", "content")
    return rows.mapInPandas(build, ROWS)


def _begins(n: int, size: int) -> np.ndarray:
    return np.arange(n // size) * n // (n // size)


def _words(b: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(w, dtype=np.uint64) for w in b["words"]]


def segments_of(b: pd.DataFrame, size: int, probe: bool, after: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the text) of the stored segments, or of the substrings a later text probes with."""
    words = _words(b)
    n = np.array([len(w) for w in words], dtype=np.int64)
    begin = np.cumsum(n) - n
    many = np.where(b["batch"].to_numpy() > after, n - size + 1, 0) if probe else n // size
    text = np.repeat(np.arange(len(n)), many)
    i = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    at = begin[text] + (i if probe else i * n[text] // many[text])
    return _grams(np.concatenate(words) if words else np.zeros(0, np.uint64), size)[at], text.astype(np.uint64)


def rarest_of(b: pd.DataFrame, often: np.ndarray, share: float, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the text) of the rarest sequences that one of two near texts must share with the other."""
    out = [np.zeros(0, np.uint64)]
    wanted = b["as_probe" if probe else "as_stored"].to_numpy()
    for w, ok in zip(_words(b), wanted):
        t = np.unique(_grams(w, 3)) if ok else out[0]
        order = np.lexsort((t, often[(t >> _SLOT).astype(np.int64)]))
        out.append(t[order[: len(t) - int(np.ceil(share * len(t) - 1e-9)) + 1]] if ok else t)
    return np.concatenate(out), np.repeat(np.arange(len(wanted)), [len(x) for x in out[1:]]).astype(np.uint64)


def blocks(rows: DataFrame, buckets: int, cut, probe: bool, in_batch: int = IN_BATCH, sketches: bool = False) -> DataFrame:
    """The hashes that ``cut`` takes from index rows, packed by hash range.

    A record is 40 bits of the hash and the text's number in the block. A hash that more than
    ``in_batch`` texts of one Arrow batch have is hot: of stored texts the earliest stands for it, and all are noted.
    """

    def rows_of(kind: int, bucket: np.ndarray, rec: np.ndarray, b: pd.DataFrame, sketch: np.ndarray | None) -> Iterator[tuple]:
        order = np.argsort(bucket, kind="stable")
        bucket, rec = bucket[order], rec[order]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
        sids = (b["cid"].to_numpy() & _SHORT).astype(np.uint32)
        ns, needs, batch = b["n"].to_numpy(np.int32), np.clip(b["need"].to_numpy(), 0, 255).astype(np.uint8), b["batch"].to_numpy(np.int32)
        for lo, hi in zip(starts, [*starts[1:], len(bucket)]):
            part = rec[lo:hi]
            used, local = np.unique(part & np.uint64((1 << 24) - 1), return_inverse=True)
            used = used.astype(np.int64)
            own = None
            if sketch is not None:  # the XOR of its halves is itself a sketch; of long texts both
                own = (sketch[used, :4] ^ sketch[used, 4:]).tobytes() + sketch[used[ns[used] >= LONG], 4:].tobytes()
            yield int(bucket[lo]), kind, _planes(part >> _LOCAL, 5), _planes(local.astype(np.uint32), 3), _planes(sids[used], 4), _planes(ns[used], 4), needs[used].tobytes(), _planes(batch[used], 4), own

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.sort_values(["batch", "cid"]).drop_duplicates("cid", keep="last" if probe else "first", ignore_index=True)  # the least number is the earliest
            h, text = cut(b)
            sketch = np.array(b["sketch"].tolist(), dtype=np.int64).reshape(-1, 8) if sketches else None
            bucket = ((h >> _KEY) % np.uint64(buckets)).astype(np.int64)
            rec = (h << _LOCAL) | text
            order = np.lexsort((rec, bucket))
            bucket, rec = bucket[order], rec[order]
            new = np.r_[True, (rec[1:] != rec[:-1]) | (bucket[1:] != bucket[:-1])] if len(rec) else np.zeros(0, bool)
            bucket, rec = bucket[new], rec[new]
            key = rec >> _LOCAL
            first = np.r_[True, (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])] if len(rec) else np.zeros(0, bool)
            group = np.cumsum(first) - 1
            hot = (np.bincount(group) > in_batch)[group] if len(rec) else first
            out = [*rows_of(PROBE if probe else STORED, bucket[~hot], rec[~hot], b, sketch), *rows_of(HOT_PROBE if probe else HOT_STORED, bucket[hot], rec[hot], b, sketch)]
            if not probe:
                out += rows_of(HOT_KEY, bucket[hot & first], rec[hot & first], b, sketch)
            yield pd.DataFrame(out, columns=["bucket", "kind", "keys", "texts", "sids", "ns", "needs", "batches", "sketches"])

    return (rows if sketches else rows.drop("sketch")).mapInPandas(make, BLOCKS)


class _Records:
    """Records of some kinds of one bucket with the texts they belong to; copies of a text are one text.

    Of copies the earliest batch stands for a stored text, the latest for a probe: more may meet, never less.
    """

    def __init__(self, rows: pd.DataFrame, *kinds: int, latest: bool = False):
        rows = rows[rows["kind"].isin(kinds)]
        join = lambda name, width, kind: np.concatenate([np.zeros(0, kind), *(_from_planes(x, width, kind) for x in rows[name])])
        sizes = np.array([len(x) // 4 for x in rows["sids"]], dtype=np.int64)
        offset = np.repeat(np.cumsum(sizes) - sizes, [len(x) // 5 for x in rows["keys"]]) if len(rows) else np.zeros(0, np.int64)
        sid, n, need, batch = join("sids", 4, np.uint32), join("ns", 4, np.int32), join("needs", 1, np.uint8), join("batches", 4, np.int32)
        self.sketch = None
        if len(rows) and rows["sketches"].iloc[0] is not None:
            each = [np.frombuffer(x, dtype=np.uint64).reshape(-1, 4) for x in rows["sketches"]]
            self.sketch = np.zeros((len(sid), 8), np.uint64)
            self.sketch[:, :4] = np.concatenate([x[:k] for x, k in zip(each, sizes)])
            self.sketch[n >= LONG, 4:] = np.concatenate([x[k:] for x, k in zip(each, sizes)])
        other = np.zeros(len(sid), np.uint64) if self.sketch is None else self.sketch[:, 0]
        order = np.lexsort((batch, other, n, sid))
        differs = lambda x: x[order][1:] != x[order][:-1]
        first = np.flatnonzero(np.r_[True, differs(sid) | differs(n) | differs(other)]) if len(sid) else np.zeros(0, np.int64)
        last = np.r_[first[1:], len(sid)] - 1 if len(sid) else first
        same = np.zeros(len(sid), np.int64)
        same[order] = np.repeat(np.arange(len(first)), last - first + 1)
        self.sid, self.n, self.batch = sid[order][first].astype(np.int64), n[order][first], batch[order][last if latest else first]
        self.need = (np.minimum.reduceat(need[order], first) if len(first) else need).astype(np.int32)
        if self.sketch is not None:
            self.sketch = self.sketch[order][first]
        key, text = join("keys", 5, np.uint64), same[join("texts", 3, np.uint32) + offset]
        order = np.lexsort((text, key))
        key, text = key[order], text[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])] if len(key) else np.zeros(0, bool)
        self.key, self.text = key[new], text[new]


def _odd_at_least(x: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Odd places of two sketches from the XOR of what their blocks hold: folded, and of ``whole`` ones the upper half."""
    upper = np.where(whole[:, None], x[:, 4:], np.uint64(0))
    return (np.bitwise_count(x[:, :4] ^ upper).astype(np.int64) + np.bitwise_count(upper)).sum(axis=1)


def _meet(bucket: int, rows: pd.DataFrame, share: float, most: int) -> Iterator[pd.DataFrame]:
    """Pairs of one hash range, and the texts and leaders of its hot segments."""
    s, p = _Records(rows, STORED), _Records(rows, PROBE, latest=True)
    hot_s, hot_p, lead = _Records(rows, HOT_STORED), _Records(rows, HOT_PROBE, latest=True), _Records(rows, HOT_KEY)
    key, text = s.key, s.text
    distinct, counts = np.unique(key, return_counts=True)
    hot = np.unique(np.concatenate([distinct[counts > most], lead.key, hot_p.key]))
    whole = lambda k: (np.int64(bucket) << np.int64(40)) | k.astype(np.int64)
    frame = lambda kind, sid, m, k, hits=0: pd.DataFrame({"kind": np.int32(kind), "sid": sid, "m_sid": m, "key": k, "hits": np.int32(hits), "need": np.int32(0)}).drop_duplicates()
    in_hot = np.isin(key, hot)
    noted = pd.DataFrame({"sid": np.concatenate([s.sid[text[in_hot]], hot_s.sid[hot_s.text]]), "k": np.concatenate([key[in_hot], hot_s.key])}).drop_duplicates().groupby("sid").size()
    yield frame(HOT_STORED, noted.index.to_numpy(dtype=np.int64), np.int64(0), np.int64(0), noted.to_numpy())
    of_probe = np.isin(p.key, hot)
    yield frame(HOT_PROBE, np.concatenate([p.sid[p.text[of_probe]], hot_p.sid[hot_p.text]]), np.int64(0), whole(np.concatenate([p.key[of_probe], hot_p.key])))
    leads = pd.DataFrame({"k": np.concatenate([key[in_hot], lead.key]), "b": np.concatenate([s.batch[text[in_hot]], lead.batch[lead.text]]), "m": np.concatenate([s.sid[text[in_hot]], lead.sid[lead.text]])})
    leads = leads.sort_values(["k", "b", "m"]).drop_duplicates("k")
    yield frame(HOT_KEY, np.int64(0), leads["m"].to_numpy(), whole(leads["k"].to_numpy(dtype=np.uint64)))
    p_key, p_text = p.key[~of_probe], p.text[~of_probe]
    low, high = np.searchsorted(key, p_key), np.searchsorted(key, p_key, side="right")
    met = np.flatnonzero(high > low)
    for part in np.split(met, np.flatnonzero(np.diff(np.cumsum((high - low)[met]) // PAIRS_AT_ONCE)) + 1):
        many = (high - low)[part]
        a = np.repeat(p_text[part], many)
        m = text[np.repeat(low[part] - (np.cumsum(many) - many), many) + np.arange(len(a))]
        small, large = np.minimum(p.n[a], s.n[m]), np.maximum(p.n[a], s.n[m])
        ok = (s.batch[m] < p.batch[a]) & (small * (1 + 1e-9) >= share * large)
        pair, hits = np.unique(a[ok] * len(s.sid) + m[ok], return_counts=True)
        a, m = np.divmod(pair, max(1, len(s.sid)))
        if s.sketch is not None:
            near = np.zeros(len(a), bool)
            for at in range(0, len(a), SKETCHES_AT_ONCE):
                x, y = a[at : at + SKETCHES_AT_ONCE], m[at : at + SKETCHES_AT_ONCE]
                near[at : at + len(x)] = _odd_at_least(p.sketch[x] ^ s.sketch[y], (p.n[x] >= LONG) & (s.n[y] >= LONG)) <= bounded(share, p.n[x] + s.n[y])
            a, m, hits = a[near], m[near], hits[near]
        yield pd.DataFrame({"kind": np.int32(STORED), "sid": p.sid[a], "m_sid": s.sid[m], "key": np.int64(0), "hits": hits.astype(np.int32), "need": s.need[m]})


def met(segments: DataFrame, probes: DataFrame, buckets: int, share: float, most: int = HOT) -> DataFrame:
    """What meets in any hash range; a range is one task and a bounded number of records."""

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame(columns=["bucket", "kind", "keys", "texts", "sids", "ns", "needs", "batches", "sketches"]), *batches])
        for bucket, part in rows.groupby("bucket"):
            yield from _meet(int(bucket), part, share, most)

    return segments.unionByName(probes).repartitionById(buckets, F.col("bucket")).mapInPandas(meet, MET)


def bounded(share: float, total: Column | np.ndarray):
    """Most insertions and deletions that two sequence sets of ``total`` members may need."""
    c = (1 - share) / (1 + share) + 1e-9
    return F.floor(F.lit(c) * total) if isinstance(total, Column) else np.floor(c * total)


def _odd(a: Column, b: Column) -> Column:
    return sum((F.bit_count(a["sketch"][i].bitwiseXOR(b["sketch"][i])) for i in range(8)), F.lit(0))


def _may_be_near(a: Column, b: Column, share: float) -> Column:
    """Length bound and odd-sketch bound of two structs (n, sketch): no near pair fails it."""
    fits = F.least(a["n"], b["n"]) * (1 + 1e-9) >= share * F.greatest(a["n"], b["n"])
    return fits & (_odd(a, b) <= bounded(share, a["n"] + b["n"]))


def _verified(pairs: DataFrame, rows: DataFrame, meta: DataFrame, share: float) -> DataFrame:
    """cid of each text that is within the bounded distance of an earlier one of its pairs (sid, m_sid).

    The pair with the nearest sketch is verified first; the others only of texts that it leaves open.
    """
    own = meta.withColumn("sid", short_id(F.col("cid")))
    m = own.select(F.col("sid").alias("m_sid"), F.col("cid").alias("m_cid"), F.col("lo").alias("m_lo"), F.col("f").alias("m_f"))
    bounds = (F.col("m_lo") < F.col("lo")) & (F.col("cid") != F.col("m_cid")) & _may_be_near(F.col("f"), F.col("m_f"), share)
    near = pairs.repartition("sid").distinct().join(own, "sid").join(m, "m_sid").where(bounds)
    near = stored(near.select("cid", "m_cid", _odd(F.col("f"), F.col("m_f")).alias("odd")))
    best = near.groupBy("cid").agg(F.min(F.struct("odd", "m_cid")).alias("b")).select("cid", "b.m_cid")
    first = stored(_within(best, rows, share))
    rest = near.join(first, "cid", "left_anti").join(best, ["cid", "m_cid"], "left_anti").select("cid", "m_cid")
    return first.unionByName(_within(rest, rows, share)).distinct()


def _within(pairs: DataFrame, rows: DataFrame, share: float) -> DataFrame:
    wanted = broadcast_if_small(pairs.select("cid").union(pairs.select("m_cid")).distinct())
    full = rows.select("cid", "words").join(wanted, "cid", "left_semi").groupBy("cid").agg(F.first("words").alias("words"))
    both = pairs.join(full, "cid").join(full.select(F.col("cid").alias("m_cid"), F.col("words").alias("m_words")), "m_cid")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = lambda w: np.unique(_grams(np.frombuffer(w, dtype=np.uint64), 3))
        for b in batches:
            keep = []
            for cid, x, y in zip(b["cid"], b["words"], b["m_words"]):
                x, y = of(x), of(y)
                total = len(x) + len(y)
                if total - 2 * len(np.intersect1d(x, y, assume_unique=True)) <= bounded(share, total):
                    keep.append(cid)
            yield pd.DataFrame({"cid": pd.Series(keep, dtype="int64")})

    return both.select("cid", "words", "m_words").mapInPandas(verify, "cid long").distinct()


def sequence_counts(noted: DataFrame) -> np.ndarray:
    """How many sequences of the noted texts fall into each of SLOTS hash slots: an order of rarity of fixed size.

    Each task sends its table in PARTS pieces, and equal pieces are added up by one task each.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SLOTS, dtype=np.int64)
        for b in batches:
            slots = [(_grams(w, 3) >> _SLOT).astype(np.int64) for w in _words(b)]
            total += np.bincount(np.concatenate([np.zeros(0, np.int64), *slots]), minlength=SLOTS)
        if total.any():
            yield pd.DataFrame({"part": np.arange(PARTS, dtype=np.int32), "c": [x.tobytes() for x in np.split(total, PARTS)]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, c in zip(b["part"].tolist(), b["c"]):
                c = np.frombuffer(c, dtype=np.int64)
                sums[part] = sums[part] + c if part in sums else c
        yield pd.DataFrame({"part": pd.Series(list(sums), dtype="int32"), "c": [c.tobytes() for c in sums.values()]})

    tables = noted.select("words").mapInPandas(count, "part int, c binary")
    rows = tables.repartitionById(PARTS, F.col("part")).mapInPandas(add, "part int, c binary").collect()
    out = np.zeros((PARTS, SLOTS // PARTS), dtype=np.int64)
    for r in rows:
        out[r["part"]] = np.frombuffer(r["c"], dtype=np.int64)
    return out.reshape(-1)


def _prefix_pairs(sides: DataFrame, rows: DataFrame, share: float) -> DataFrame:
    """(sid, m_sid) of the texts of ``sides`` (cid, as_stored, as_probe) whose rarest sequences meet, within the bounds of length and sketch."""
    noted = stored(rows.join(broadcast_if_small(sides), "cid"))
    buckets, often = bucket_count(noted, 2 * (1 - share)), noted.sparkSession.sparkContext.broadcast(sequence_counts(noted))
    of = lambda probe: blocks(noted, buckets, lambda b: rarest_of(b, often.value, share, probe), probe, 1 << 40, True)
    return stored(met(of(False), of(True), buckets, share, 1 << 40).where(F.col("kind") == STORED).select("sid", "m_sid"))


def near_history(rows: DataFrame, found: DataFrame, share: float = SHARE) -> DataFrame:
    """cid of each content for which an earlier batch holds a near, not equal, content.

    ``rows``: index rows of history and batch; ``found``: what met (see ``met``), stored.
    """
    meta = stored(rows.groupBy("cid").agg(F.min("batch").alias("lo"), F.first(F.struct("n", "sketch")).alias("f"), F.min("need").alias("need"), F.max("repeats").alias("repeats")))
    of = lambda kind: found.where(F.col("kind") == kind)
    texts = meta.select("cid", "need", "repeats", short_id(F.col("cid")).alias("sid"))
    meta = meta.drop("need", "repeats")
    leaders = of(HOT_KEY).groupBy("key").agg(F.min("m_sid").alias("m_sid"))
    lead = of(HOT_PROBE).select("sid", "key").join(leaders, "key").select("sid", "m_sid")
    hot = stored(of(HOT_STORED).groupBy("sid").agg(F.sum("hits").alias("h")))
    few = broadcast_if_small(hot.select(F.col("sid").alias("m_sid"), "h"))
    pairs = of(STORED).repartition("sid").groupBy("sid", "m_sid").agg(F.sum("hits").alias("hits"), F.min("need").alias("need"))
    cold = F.col("need") - F.when(F.col("h") < F.col("need"), F.col("h")).otherwise(0)
    enough = pairs.join(few, "m_sid", "left").where(F.col("hits") >= F.coalesce(cold, "need"))
    first = stored(_verified(enough.select("sid", "m_sid").unionByName(lead), rows, meta, share))
    repeats = texts.where("repeats").select("cid")
    open_ = texts.join(of(HOT_PROBE).select("sid").distinct(), "sid", "left_semi").select("cid").unionByName(repeats).join(first, "cid", "left_anti")
    least = texts.groupBy("sid").agg(F.least(F.min("need"), F.lit(255)).alias("least"))  # a block holds 255 at most
    kept = texts.join(hot.join(least, "sid").where("h >= least"), "sid", "left_semi").select("cid").unionByName(repeats)
    sides = open_.select("cid", F.lit(False).alias("s"), F.lit(True).alias("p")).unionByName(kept.select("cid", F.lit(True).alias("s"), F.lit(False).alias("p")))
    sides = stored(sides.groupBy("cid").agg(F.max("s").alias("as_stored"), F.max("p").alias("as_probe")))
    return first.unionByName(_verified(_prefix_pairs(sides, rows, share), rows, meta, share)).distinct()


def bucket_count(rows: DataFrame, of_a_word: float = 1.2) -> int:
    """Hash ranges, so that each holds BUCKET_RECORDS records at most on average, at so many records of a word."""
    words = rows.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"]
    return max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-int(words * of_a_word) // BUCKET_RECORDS))


def chunks_seen_before(chunks: DataFrame, share: float = SHARE, hot: int = HOT, in_batch: int = IN_BATCH) -> DataFrame:
    """chunk_id of every chunk whose content, unchanged or near, stands in a smaller batch."""
    contents = _contents(chunks)
    rows = stored(index_rows(contents, share))
    buckets, size = bucket_count(rows), segment_words(share)
    earliest = rows.agg(F.coalesce(F.min("batch"), F.lit(0)).alias("b")).first()["b"]  # it has nothing before it and probes nothing
    of = lambda probe: blocks(rows, buckets, lambda b: segments_of(b, size, probe, earliest), probe, in_batch)
    near = near_history(rows, stored(met(of(False), of(True), buckets, share, hot)), share)
    equal = contents.where("sha is not null and batch is not null").groupBy("sha").agg(F.min("batch").alias("lo"), F.max("batch").alias("hi"))
    state = equal.withColumn("cid", F.xxhash64("sha")).join(near.withColumn("near", F.lit(True)), "cid", "left").select("sha", "lo", "hi", F.coalesce("near", F.lit(False)).alias("near"))
    state = state.where("near or hi > lo")
    found = contents.drop("content").distinct().join(state, "sha").where(F.col("near") | (F.col("batch") > F.col("lo")))
    return found.select("chunk_id").where("chunk_id is not null and batch is not null").distinct()


def append(batch: DataFrame, path: str, buckets: int, share: float = SHARE) -> None:
    """Add a batch's index rows and segment blocks to the stored history."""
    batch.write.mode("append").parquet(f"{path}/rows")
    size = segment_words(share)
    blocks(batch, buckets, lambda b: segments_of(b, size, False, 0), False).write.mode("append").parquet(f"{path}/segments")


def probe(path: str, batch: DataFrame, buckets: int, share: float = SHARE) -> DataFrame:
    """cid of the contents of a new batch (index rows) that the history stored at ``path`` explains.

    Only the stored segment blocks are read, and the rows of texts that met; nothing of the history is
    cut or counted again. Afterwards ``append`` the accepted rows.
    """
    spark = batch.sparkSession
    segments, history = spark.read.parquet(f"{path}/segments"), spark.read.parquet(f"{path}/rows")
    size = segment_words(share)
    found = stored(met(segments, blocks(batch, buckets, lambda b: segments_of(b, size, True, -1), True), buckets, share))
    needed = found.select("sid").union(found.select(F.col("m_sid").alias("sid"))).distinct()
    near = near_history(history.join(needed, short_id(history["cid"]) == needed["sid"], "left_semi").unionByName(batch), found, share)
    same = batch.select("cid").distinct().join(history.select("cid").distinct(), "cid", "left_semi")
    return near.join(batch.select("cid").distinct(), "cid", "left_semi").unionByName(same).distinct()


def entries_seen_before(files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """entry_id of added paths with content that stands in a complete snapshot of earlier created_at.

    Same size and checksum, or same size and quick_hash where one of the two has no checksum.
    The earliest time per content is aggregated before the join: hot contents meet one row each.
    """
    from ..operators.snapshots import complete_sequence, held_rows, snapshot_changes

    held = held_rows(files, complete_sequence(snapshots), "checksum", "quick_hash").select("size", "created_at", normal.digest("checksum").alias("sum"), normal.key("quick_hash").alias("quick"))
    added = snapshot_changes(files, snapshots, "checksum", "quick_hash").where("change_kind = 'added' and size > 0")
    added = added.select("entry_id", "size", "created_at", normal.digest("checksum").alias("sum"), normal.key("quick_hash").alias("quick"))
    by_sum = held.where("sum is not null and size > 0").groupBy("size", "sum").agg(F.min("created_at").alias("t_sum"))
    by_quick = held.where("quick is not null and size > 0").groupBy("size", "quick").agg(F.min("created_at").alias("t_any"), F.min(F.when(F.col("sum").isNull(), F.col("created_at"))).alias("t_bare"))
    met = added.join(by_sum, ["size", "sum"], "left").join(by_quick, ["size", "quick"], "left")
    earlier = F.least("t_sum", F.when(F.col("sum").isNull(), F.col("t_any")).otherwise(F.col("t_bare")))
    return met.where(earlier < F.col("created_at")).select("entry_id").distinct()
