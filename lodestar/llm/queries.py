"""Registered queries of the training-data operators."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import bpe, budget, history, leakage, origin, quality, secrets, syntax


TOKENIZERS = os.environ.get("LODESTAR_TOKENIZERS", "/opt/tokenizers")


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    chunks = table(spark, base, "chunks", "chunk_id", "content_sha256", "batch_no", "content")
    files = table(spark, base, "files", "entry_id", "snapshot_id", "rel_path", "size_bytes", "mtime", "ingested_at", "checksum", "quick_hash")
    snaps = table(spark, base, "snapshots", "snapshot_id", "root_id", "created_at", "status", "ingested_at")
    a = history.chunks_seen_before(chunks).select(F.lit("chunk").alias("record_kind"), F.col("chunk_id").alias("record_key"))
    b = history.entries_seen_before(files, snaps).select(F.lit("entry").alias("record_kind"), F.col("entry_id").cast("string").alias("record_key"))
    return a.unionByName(b)


def _file_chunks(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "chunks", "repo_id", "path", "start_byte", "content")


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return origin.file_origins(_file_chunks(spark, base)).select("repo_id", "path").distinct()


def p6_origins(spark: SparkSession, base: str) -> DataFrame:
    rows = origin.file_origins(_file_chunks(spark, base))
    return rows.groupBy("repo_id", "origin").agg(F.count("*").alias("n_files"))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return syntax.parsed_files(_file_chunks(spark, base)).where("error_line is not null").select("repo_id", "path")


def p2_rates(spark: SparkSession, base: str) -> DataFrame:
    return syntax.error_rates(syntax.parsed_files(_file_chunks(spark, base)))


def p2_errors(spark: SparkSession, base: str) -> DataFrame:
    """The first line of each file at which its parse cannot go on."""
    return syntax.parsed_files(_file_chunks(spark, base)).where("error_line is not null").select("repo_id", "path", "ext", "error_line")


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return secrets.secrets(table(spark, base, "chunks", "chunk_id", "content")).select("chunk_id", "line_no").distinct()


def p4_redacted(spark: SparkSession, base: str) -> DataFrame:
    return secrets.redacted(table(spark, base, "chunks", "chunk_id", "content"))


def p7_tokens(spark: SparkSession, base: str) -> DataFrame:
    chunks = table(spark, base, "chunks", "chunk_id", "repo_id", "language", "layer", "size_bytes", "content")
    return budget.token_budget(chunks, table(spark, base, "bundles", "repo_id", "tags"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p7_domains(spark: SparkSession, base: str) -> DataFrame:
    return budget.domain_budget(p7_tokens(spark, base))


def p8_ids(spark: SparkSession, base: str) -> DataFrame:
    return bpe.encode(table(spark, base, "documents", "doc_id", "text"), bpe.load_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"))


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    docs, items = table(spark, base, "documents", "doc_id", "text"), table(spark, base, "goldset", "item_id", "passage")
    return leakage.contained_items(docs, items).select("doc_id", "item_id")


def p9_items(spark: SparkSession, base: str) -> DataFrame:
    """Documents that hold each test item."""
    docs, items = table(spark, base, "documents", "doc_id", "text"), table(spark, base, "goldset", "item_id", "passage")
    return leakage.contained_items(docs, items).groupBy("item_id").agg(F.count("*").alias("n_documents"))


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return quality.not_prose(table(spark, base, "documents", "doc_id", "text"))


def p10_statistics(spark: SparkSession, base: str) -> DataFrame:
    return quality.verdicts(table(spark, base, "documents", "doc_id", "text").distinct())


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_rates": p2_rates, "p2_errors": p2_errors, "p4_found": p4_found, "p4_redacted": p4_redacted, "p6_found": p6_found, "p6_origins": p6_origins, "p7_tokens": p7_tokens, "p7_domains": p7_domains, "p8_ids": p8_ids, "p9_found": p9_found, "p9_items": p9_items, "p10_found": p10_found, "p10_statistics": p10_statistics}
_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"
_P9 = """WITH it AS (SELECT DISTINCT item_id, regexp_extract_all(lower(nfc_normalize(passage)), '[\\p{L}\\p{N}]+') AS w FROM goldset WHERE passage IS NOT NULL),
iw AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM it)),
d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
dw AS (SELECT doc_id, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
hit AS (SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g))"""
_P1 = """WITH RECURSIVE k AS (SELECT DISTINCT chunk_id, batch_no AS batch, content, coalesce(sha256(content), nullif(regexp_replace(lower(trim(content_sha256)), '^[a-z0-9-]+:', ''), '')) AS sha FROM chunks),
first AS (SELECT sha, min(batch) AS lo FROM k WHERE sha IS NOT NULL AND batch IS NOT NULL GROUP BY 1),
txt AS (SELECT DISTINCT sha, """ + _WORDS.format("content") + """ AS w FROM k WHERE content IS NOT NULL AND batch IS NOT NULL),
tri AS (SELECT DISTINCT sha, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT sha, w, unnest(range(1, len(w) - 1)) AS i FROM txt WHERE len(w) >= 40)),
size AS (SELECT sha, count(*) AS n FROM tri GROUP BY 1),
shared AS (SELECT a.sha AS x, b.sha AS y, count(*) AS c FROM tri a JOIN tri b ON a.t = b.t JOIN first fa ON fa.sha = a.sha JOIN first fb ON fb.sha = b.sha WHERE fb.lo < fa.lo GROUP BY 1, 2),
near AS (SELECT DISTINCT x AS sha FROM shared JOIN size p ON p.sha = x JOIN size q ON q.sha = y WHERE c >= 0.6 * (p.n + q.n - c)),
part1 AS (SELECT DISTINCT 'chunk' AS record_kind, k.chunk_id AS record_key FROM k JOIN first USING (sha) WHERE k.chunk_id IS NOT NULL AND (k.batch > first.lo OR (k.batch IS NOT NULL AND k.sha IN (SELECT sha FROM near))))"""


def _entries() -> str:
    """The second half of p1 in SQL: the changes of p3 with the digests of the rows that hold."""
    from ..catalog.integrity import _CHANGES

    sql = _CHANGES.replace("size_bytes AS size, entry_id, ingested_at,", "size_bytes AS size, entry_id, ingested_at, nullif(regexp_replace(lower(trim(checksum)), '^[a-z0-9-]+:', ''), '') AS s, lower(trim(quick_hash)) AS q,")
    sql = sql.replace("seq.next_sid, f.size, f.m FROM f", "seq.next_sid, seq.created_at, f.entry_id, f.s, f.q, f.size, f.m FROM f").strip().removeprefix("WITH ")
    return sql + """, part2 AS (SELECT DISTINCT 'entry' AS record_kind, CAST(b.entry_id AS VARCHAR) AS record_key FROM held b JOIN changes c ON c.snapshot_id = b.sid AND c.rel_path = b.path AND c.change_kind = 'added'
JOIN held o ON o.size = b.size AND o.created_at < b.created_at AND (o.s = b.s OR ((o.s IS NULL OR b.s IS NULL) AND o.q = b.q)) WHERE b.size > 0)"""


SQL: dict[str, str] = {
    "p1_found": _P1 + ", " + _entries() + " SELECT * FROM part1 UNION ALL SELECT * FROM part2",
    "p9_found": _P9 + " SELECT * FROM hit",
    "p9_items": _P9 + " SELECT item_id, count(*) AS n_documents FROM hit GROUP BY 1",
}
