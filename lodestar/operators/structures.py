"""Lexical structure of Bash and Rust files, expected edges, freshness, and latencies of routes.

Defined cases: null contents give no rows; a function named twice in a file is two rows by line; comments
and strings are blanked before Rust is searched, so that code inside them is no structure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASH_FUNCTION = r"^[ \t]*(?:function[ \t]+)?([A-Za-z_][A-Za-z0-9_:-]*)[ \t]*\(\)[ \t]*\{?"
RUST_ITEM = r"^[ \t]*(?:pub(?:\([a-z]+\))?[ \t]+)?(?:async[ \t]+|unsafe[ \t]+|const[ \t]+)*(fn|struct|enum|trait|mod)[ \t]+([A-Za-z_][A-Za-z0-9_]*)"


def _lines(files: DataFrame, text: Column) -> DataFrame:
    return files.select("repo_id", "path", F.posexplode(F.split(text, "\n")).alias("at", "line")).withColumn("line_no", F.col("at") + 1)


def bash_functions(files: DataFrame) -> DataFrame:
    """(repo_id, path, line_no, name) of functions in shell files."""
    rows = _lines(files.where("path like '%.sh' and content is not null"), F.col("content"))
    return rows.select("repo_id", "path", "line_no", F.regexp_extract("line", BASH_FUNCTION, 1).alias("name")).where("name <> ''")


def blanked_rust(text: Column) -> Column:
    """Line comments and strings of one line as blanks; lines keep their number."""
    return F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\\n]|\\.)*"', '""'), r"//[^\n]*", "")


def rust_items(files: DataFrame) -> DataFrame:
    """(repo_id, path, line_no, kind, name) of functions, types, traits and modules in Rust files."""
    rows = _lines(files.where("path like '%.rs' and content is not null"), blanked_rust(F.col("content")))
    return rows.select("repo_id", "path", "line_no", F.regexp_extract("line", RUST_ITEM, 1).alias("kind"), F.regexp_extract("line", RUST_ITEM, 2).alias("name")).where("name <> ''")


def edge_quality(expected: DataFrame, forbidden: DataFrame, actual: DataFrame) -> DataFrame:
    """How many expected edges (src, dst) are there, and how many forbidden ones."""
    there = actual.select("src", "dst").distinct().withColumn("there", F.lit(True))
    e = expected.select("src", "dst").distinct().join(there, ["src", "dst"], "left").agg(F.count("*").alias("n_expected"), F.count("there").alias("n_found"))
    f = forbidden.select("src", "dst").distinct().join(there, ["src", "dst"], "left_semi").agg(F.count("*").alias("n_forbidden"))
    return e.withColumn("recall", F.round(F.try_divide("n_found", "n_expected"), 6)).withColumn("n_forbidden", f.select("n_forbidden").scalar())


def freshness(rows: DataFrame, at: Column, newest: str, days: int) -> DataFrame:
    """Adds ``freshness``, the first reason that holds: no_time, future, stale or fresh."""
    t = F.col(newest)
    state = F.when(t.isNull(), "no_time").when(t > at, "future").when(t < at - F.expr(f"interval {days} days"), "stale").otherwise("fresh")
    return rows.withColumn("freshness", state)


def route_latencies(rows: DataFrame, route: str, value: str, category: str) -> DataFrame:
    """Count, median, greatest value and sum per route, overall and per category in one pass."""
    measures = [F.count(value).alias("n"), F.round(F.median(value), 6).alias("median"), F.round(F.max(value), 6).alias("greatest"), F.round(F.sum(value), 4).alias("total")]
    out = rows.groupingSets([[F.col(route)], [F.col(route), F.col(category)]], F.col(route), F.col(category)).agg(*measures, F.grouping(category).alias("all"))
    return out.withColumn(category, F.when(F.col("all") == 1, "(all)").otherwise(F.col(category))).drop("all")
