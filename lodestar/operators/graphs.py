"""Graph distances, navigation over symbols and calls, and module resolution."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import counted, stored


def bfs_distances(nodes: DataFrame, edges: DataFrame, roots: DataFrame, most_levels: int | None = None) -> DataFrame:
    """Least number of edges from any root to every node, -1 if none leads there.

    Level by level: the frontier meets the edges, nodes already reached are taken out, the new
    level is written to the shared folder. Ends when a level is empty.
    """
    edges = stored(edges.select("src", "dst").distinct())
    reached, found = counted(roots.select("node").distinct().withColumn("distance", F.lit(0)))
    frontier, level = reached, 0
    while found and (most_levels is None or level < most_levels):
        level += 1
        step = frontier.select(F.col("node").alias("src")).join(edges, "src").select(F.col("dst").alias("node")).distinct()
        frontier, found = counted(step.join(reached, "node", "left_anti").withColumn("distance", F.lit(level)))
        reached = reached.unionByName(frontier)
    return nodes.select("node").distinct().join(reached, "node", "left").select("node", F.coalesce("distance", F.lit(-1)).alias("distance"))


def definitions(chunks: DataFrame) -> DataFrame:
    """(name, repo_id, path, chunk_id) of top-level and nested functions of Python chunks, by pattern."""
    rows = chunks.where("path like '%.py' and content is not null")
    return rows.select("repo_id", "path", "chunk_id", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^[ \t]*(?:async[ \t]+)?def[ \t]+([A-Za-z_][A-Za-z0-9_]*)"), 1)).alias("name")).distinct()


def call_sites(chunks: DataFrame) -> DataFrame:
    """(callee, repo_id, path, chunk_id, n) of plain-name calls in Python chunks."""
    rows = chunks.where("path like '%.py' and content is not null")
    found = F.explode(F.regexp_extract_all("content", F.lit(r"(?:^|[^A-Za-z0-9_.])([A-Za-z_][A-Za-z0-9_]*)\("), 1))
    return rows.select("repo_id", "path", "chunk_id", found.alias("callee")).groupBy("repo_id", "path", "chunk_id", "callee").agg(F.count("*").alias("n"))


def resolve_calls(calls: DataFrame, defs: DataFrame) -> DataFrame:
    """Status of each call site: local (same file), resolved (one definition in the repository), candidate (several), unresolved."""
    local = defs.select("repo_id", "path", F.col("name").alias("callee")).distinct().withColumn("here", F.lit(True))
    repo = defs.groupBy("repo_id", F.col("name").alias("callee")).agg(F.count_distinct("path").alias("n_files"))
    x = calls.join(local, ["repo_id", "path", "callee"], "left").join(repo, ["repo_id", "callee"], "left")
    status = F.when(F.col("here"), "local").when(F.col("n_files") == 1, "resolved").when(F.col("n_files") > 1, "candidate").otherwise("unresolved")
    return x.withColumn("status", status).drop("here")


def callers(calls: DataFrame, defs: DataFrame) -> DataFrame:
    """Per defined symbol the files that call it by name within its repository."""
    d = defs.select("repo_id", F.col("name").alias("callee"), F.col("path").alias("defined_in")).distinct()
    c = calls.groupBy("repo_id", "callee", "path").agg(F.sum("n").alias("n_sites"))
    return c.join(d, ["repo_id", "callee"]).groupBy("repo_id", "callee", "defined_in").agg(F.count_distinct("path").alias("n_files"), F.sum("n_sites").alias("n_sites"), F.min("path").alias("first_file"))


def callees(calls: DataFrame, defs: DataFrame) -> DataFrame:
    """Per file the defined symbols of other files that it calls."""
    d = defs.select("repo_id", F.col("name").alias("callee"), F.col("path").alias("target")).distinct()
    return calls.select("repo_id", "path", "callee").distinct().join(d, ["repo_id", "callee"]).where("target <> path").groupBy("repo_id", "path").agg(F.count_distinct("callee").alias("n_callees"), F.count_distinct("target").alias("n_targets"))


def import_edges(chunks: DataFrame) -> DataFrame:
    """(repo_id, path, module) of import statements in Python chunks."""
    rows = chunks.where("path like '%.py' and content is not null")
    lines = F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^(?:from|import)[ \t]+([A-Za-z_][A-Za-z0-9_.]*)"), 1))
    return rows.select("repo_id", "path", lines.alias("module")).distinct()


def resolve_modules(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Local file of a module by its last parts; several files make it ambiguous, none external."""
    files = paths.where("path like '%.py'").select("repo_id", "path").distinct()
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.py$", "")
    index = files.groupBy("repo_id", name.alias("leaf")).agg(F.count("*").alias("n"), F.min("path").alias("target"))
    x = edges.withColumn("leaf", F.element_at(F.split("module", r"\."), -1)).join(index, ["repo_id", "leaf"], "left")
    kind = F.when(F.col("n") == 1, "local").when(F.col("n") > 1, "ambiguous").otherwise("external")
    return x.select("repo_id", "path", "module", kind.alias("resolution"), F.when(F.col("n") == 1, F.col("target")).alias("target"))


SYMBOLS = "repo_id string, path string, kind string, qualified_name string, start_line int, end_line int, decorators array<string>"


def python_symbols(files: DataFrame) -> DataFrame:
    """Classes and functions of whole Python files by the language's own parser; files that do not parse give none."""

    def walk(node: ast.AST, prefix: str) -> Iterator[tuple]:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "async_function", ast.ClassDef: "class"}[type(n)]
                q = f"{prefix}{n.name}"
                yield kind, q, n.lineno, n.end_lineno, [ast.unparse(d) for d in n.decorator_list]
                yield from walk(n, q + ".")
            else:
                yield from walk(n, prefix)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r, p, t in zip(b["repo_id"], b["path"], b["content"]):
                try:
                    rows += [(r, p, *x) for x in walk(ast.parse(t), "")]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=["repo_id", "path", "kind", "qualified_name", "start_line", "end_line", "decorators"])

    return files.where("path like '%.py'").select("repo_id", "path", "content").mapInPandas(parse, SYMBOLS)
