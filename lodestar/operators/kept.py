"""A kept lexical index: built once per state of its source, updated by what changed, read by the terms of a query.

Tables of a generation: ``docs`` (doc, digest), ``postings`` (doc, term, tf; ranges of terms, sorted, so
that a filter on terms reads only their row groups) and ``lengths`` (doc, dl). A generation is written
whole and then named by an appended pointer, as ``sources.jsonl.publish`` does; a job that is lost
leaves the one before in force. The fingerprint of a source is that of its files (name, size, time)
and of the code: an unchanged source is answered without reading it. Texts are digested, so an update splits documents
into reused, changed, added and deleted, and only changed and added ones are cut into terms.

Defined cases: null texts count as empty and have a digest of their own; repeated rows count once; an
empty source is an empty index.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from . import retrieval as R

FEW_TERMS = 1_000


@dataclass(frozen=True)
class Index:
    docs: DataFrame
    postings: DataFrame
    lengths: DataFrame

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("docs", "postings", "lengths")))

    def of_terms(self, queries: DataFrame) -> DataFrame:
        """Postings of the terms of a query table; few terms reach the scan as literals."""
        terms = [r["term"] for r in queries.select("term").distinct().limit(FEW_TERMS + 1).collect()]
        if len(terms) <= FEW_TERMS:
            return self.postings.where(F.col("term").isin(terms))
        return self.postings.join(queries.select("term").distinct(), "term", "left_semi")

    def scores(self, queries: DataFrame) -> DataFrame:
        return R.bm25_scores(self.of_terms(queries), queries, lengths=self.lengths)


def _code() -> str:
    """Of the operators' own text: what other code has made is made anew."""
    here = Path(__file__).parent
    return hashlib.md5(b"".join(p.read_bytes() for p in sorted(here.glob("*.py")))).hexdigest()[:12]


def fingerprint(source: DataFrame, *config: str) -> str:
    """Of the files under a table, the settings and the code."""
    files = source.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    text = F.concat_ws("|", "file_path", F.col("file_size").cast("string"), F.col("file_modification_time").cast("string"))
    row = files.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("s")).first()
    return "-".join([_code(), *config, str(row["n"]), row["s"] or "0"])


def _write(docs: DataFrame, postings: DataFrame, path: str) -> Index:
    spark = docs.sparkSession
    docs.write.mode("overwrite").parquet(f"{path}/docs")
    postings.repartitionByRange("term").sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(f"{path}/postings")
    R.doc_lengths(spark.read.parquet(f"{path}/postings")).write.mode("overwrite").parquet(f"{path}/lengths")
    return Index.at(spark, path)


def digests(docs: DataFrame) -> DataFrame:
    """(doc, digest) of the delivered (doc, text)."""
    return docs.select("doc", F.md5(F.encode(F.coalesce("text", F.lit("\x00null")), "utf-8")).alias("digest")).distinct()


def build(docs: DataFrame, path: str) -> Index:
    return _write(digests(docs), R.postings(docs.distinct(), "doc", "text"), path)


def states(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc, state): reused, changed, added or deleted, by digests."""
    x = old.select("doc", F.col("digest").alias("a")).join(new.select("doc", F.col("digest").alias("b")), "doc", "full")
    state = F.when(F.col("b").isNull(), "deleted").when(F.col("a").isNull(), "added").when(F.col("a") == F.col("b"), "reused").otherwise("changed")
    return x.select("doc", state.alias("state"))


def update(index: Index, docs: DataFrame, path: str) -> Index:
    """The next generation: postings of reused documents are taken over, those of changed and added ones are made."""
    s = states(index.docs, digests(docs))
    kept = index.postings.join(s.where("state = 'reused'").select("doc"), "doc", "left_semi")
    fresh = docs.distinct().join(s.where("state in ('changed', 'added')").select("doc"), "doc", "left_semi")
    return _write(digests(docs), kept.select("doc", "term", "tf").unionByName(R.postings(fresh, "doc", "text")), path)


def kept(name: str, source: DataFrame, docs: DataFrame) -> Index:
    """The index of a source table in the shared folder, built if its files have changed since."""
    spark = source.sparkSession
    root = f"{shared_folder(spark)}/index/{name}-{fingerprint(source)}"
    try:
        spark.read.parquet(f"{root}/whole").first()
    except AnalysisException:
        build(docs, root)
        spark.range(1).write.mode("overwrite").parquet(f"{root}/whole")
    return Index.at(spark, root)


def kept_table(name: str, source: DataFrame, make, *config: str) -> DataFrame:
    """``make()`` as a table of the shared folder, made anew only if the files of ``source`` or the settings have changed."""
    spark = source.sparkSession
    root = f"{shared_folder(spark)}/kept/{name}-{fingerprint(source, *config)}"
    try:
        spark.read.parquet(f"{root}/whole").first()
    except AnalysisException:
        make().write.mode("overwrite").parquet(f"{root}/rows")
        spark.range(1).write.mode("overwrite").parquet(f"{root}/whole")
    return spark.read.parquet(f"{root}/rows")
