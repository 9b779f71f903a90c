"""Source files that are not valid in the language of their extension.

Each file is put together from its chunks, cut into the tokens of its language and parsed by
LALR(1) tables built from the bundled grammars; the first error that the automatic semicolon rule
cannot mend is reported with its line. Tables are built once per Python worker.

Defined cases: extensions without grammar (.sql, .md and others) and files with a null content in
any chunk are not judged; an empty file is valid but for .json, which needs a value; files are
parsed whole, whatever their length; repeated rows count once; a byte order mark is no token.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import source_files
from .lexers import MAKERS, language

NAMES = {".py": "python", ".js": "javascript", ".ts": "typescript", ".go": "go", ".rs": "rust", ".sh": "bash", ".json": "json", ".yaml": "yaml", ".toml": "toml"}


def extension() -> F.Column:
    """Lower-cased extension of the path's last part."""
    return F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))


def parsed_files(chunks: DataFrame) -> DataFrame:
    """(repo_id, path, ext, error_line) of every file with a grammar; error_line is null for valid ones."""
    known = chunks.withColumn("ext", extension()).where(F.col("ext").isin(*MAKERS)).drop("ext")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            errors = [language(e).first_error(t[1:] if t[:1] == "﻿" else t) for e, t in zip(b["ext"], b["content"])]
            yield b[["repo_id", "path", "ext"]].assign(error_line=pd.array(errors, dtype="Int64"))

    files = source_files(known).withColumn("ext", extension())
    return files.mapInPandas(judge, "repo_id string, path string, ext string, error_line long")


def error_rates(parsed: DataFrame) -> DataFrame:
    """Files, invalid files and their rate per repository and language."""
    name = F.coalesce(*[F.when(F.col("ext") == e, F.lit(n)) for e, n in NAMES.items()])
    return (
        parsed.groupBy("repo_id", name.alias("language"))
        .agg(F.count("*").alias("n_files"), F.count("error_line").alias("n_invalid"))
        .withColumn("rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))
    )
