"""The Python graph of the repositories; rows only, as SQL cannot parse code (tests/test_pycode.py holds the answers)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kept
from ..operators import paths as P
from ..operators import pycode as G
from ..operators.retrieval import file_context
from ..session import stored
from ..sources.tables import table
from .retrieval import chunks


def _source(spark, base):
    return table(spark, base, "chunks", "chunk_id", "repo_id", "path", "start_line", "content")


def _files(spark, base):
    c = _source(spark, base)
    return kept.kept_table("python-files", c, lambda: file_context(c.distinct().where("path like '%.py'")).select("repo_id", "path", "content"))


def _facts(spark, base):
    return kept.kept_table("python-facts", _source(spark, base), lambda: G.facts(_files(spark, base)))


def _graph(spark, base):
    """Files, facts and resolved calls, each made once per state of the chunks."""
    files, fact = _files(spark, base), _facts(spark, base)
    return files, fact, kept.kept_table("python-calls", _source(spark, base), lambda: G.resolve_calls(fact, files))


def python_imports(spark, base):
    return G.import_edges(_facts(spark, base), _files(spark, base))


def python_calls(spark, base):
    return _graph(spark, base)[2]


def python_unresolved_causes(spark, base):
    return G.unresolved_causes(_graph(spark, base)[2])


def python_callers(spark, base):
    _, fact, calls = _graph(spark, base)
    return G.caller_groups(calls, fact)


def python_callees(spark, base):
    return G.callee_groups(_graph(spark, base)[2])


def python_entry_points(spark, base):
    return _facts(spark, base).where("kind = 'entry'").select("repo_id", "path", "line").distinct()


def python_references(spark, base):
    """Every use of a called name, resolved ones first, in order of place."""
    c = _graph(spark, base)[2]
    return c.select("repo_id", F.coalesce("target_symbol", "name").alias("symbol"), (F.col("status") == "resolved").alias("exact"), "path", "line", "col")


def _cards(spark, base):
    files, fact, calls = _graph(spark, base)
    return fact, G.relation_cards(calls, G.import_edges(fact, files))


def python_relation_cards(spark, base):
    return _cards(spark, base)[1]


def _impact(spark, base):
    fact, cards = _cards(spark, base)
    changed = chunks(spark, base, "repo_id", "path", "batch_no").where("batch_no > 0 and path like '%.py'")
    return G.impact(stored(cards), changed, F.col("path").rlike(r"(^|/)tests?/|(^|/)test_[^/]*$"), fact.where("kind = 'entry'"))


def python_impact(spark, base):
    return _impact(spark, base)


def python_related_tests(spark, base):
    return G.related_tests(_impact(spark, base), 5)


def python_maintainability(spark, base):
    """Files, edges and calls per projection, and the share of calls that lead nowhere."""
    _, _, calls = _graph(spark, base)
    x = P.path_columns(calls).withColumn("projection", F.expr(P.first_of(P.PROJECTIONS)))
    x = x.groupBy("projection").agg(F.count_distinct("repo_id", "path").alias("n_files"), F.count("*").alias("n_calls"), F.count_if(F.col("status") == "unresolved").alias("n_unresolved"))
    return x.withColumn("unresolved_share", F.round(F.col("n_unresolved") / F.col("n_calls"), 6))


QUERIES = {f.__name__: f for f in (python_imports, python_calls, python_unresolved_causes, python_callers, python_callees, python_entry_points, python_references, python_relation_cards, python_impact, python_related_tests, python_maintainability)}
SQL: dict[str, str] = {}
