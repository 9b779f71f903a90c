"""From a question to a query: tokens, intent, synonyms, relaxed forms, phrases and columns.

All rules are expressions over a table of questions, so a million questions are planned like one. A
question without tokens has intent ``unknown`` and an empty query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words of the rules.
STOPWORDS = ("show", "find", "get", "where", "how", "what", "is", "are", "does", "do", "search", "list", "display", "locate", "explain", "give", "me")
INTENTS = {
    "entrypoint": ("entrypoint", "start", "main", "cli", "cmd", "run", "execute", "entry", "boot"),
    "architecture": ("architecture", "structure", "design", "layer", "module", "component", "dependency"),
    "security": ("security", "auth", "token", "credential", "password", "secret", "vulnerability", "leak"),
    "test": ("test", "mock", "fixture", "assert", "spec", "verify", "suite"),
}
SYNONYMS = {
    "index": ("indexing", "build_index", "indexer"), "indexing": ("index", "build_index", "indexer"),
    "config": ("configuration", "settings", "options"), "configuration": ("config", "settings", "options"), "settings": ("config", "configuration", "options"),
    "db": ("database", "sqlite", "sql"), "database": ("db", "sqlite", "sql"),
    "error": ("exception", "fail", "failure", "crash"), "exception": ("error", "fail", "failure", "crash"),
    "auth": ("authentication", "login", "credentials", "security"), "authentication": ("auth", "login", "credentials", "security"),
}
RESERVED = ("and", "or", "not", "near")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+"), 0)


def _quoted(token: Column) -> Column:
    return F.when(token.isin(*RESERVED), F.concat(F.lit('"'), token, F.lit('"'))).otherwise(token)


def route(questions: DataFrame, text: str = "query_text", expand: bool = True) -> DataFrame:
    """Adds intent (of the earliest trigger), kept tokens (all of them if only stop words are left) and the query with its OR groups."""
    places = [F.struct(F.array_position("all_tokens", w).alias("at"), F.lit(i).alias("i"), F.lit(name).alias("intent")) for i, (name, words) in enumerate(INTENTS.items()) for w in words]
    x = questions.withColumn("all_tokens", tokens(F.col(text)))
    hit = F.array_min(F.filter(F.array(*places), lambda p: p["at"] > 0))
    kept = F.filter("all_tokens", lambda t: ~t.isin(*STOPWORDS))
    x = x.withColumns({"intent": F.coalesce(hit["intent"], F.lit("unknown")), "kept": F.when(F.size(kept) > 0, kept).otherwise(F.col("all_tokens"))})
    table = F.create_map(*[c for k, v in SYNONYMS.items() for c in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    more = lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>")) if expand else F.array().cast("array<string>")

    def group(t: Column) -> Column:
        words = F.concat(F.array(t), more(t))
        return F.when(F.size(words) > 1, F.concat(F.lit("("), F.array_join(F.transform(words, _quoted), " OR "), F.lit(")"))).otherwise(_quoted(t))

    return x.withColumns({
        "fts_query": F.array_join(F.transform("kept", group), " AND "),
        "synonyms": F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform("kept", more)))), ","),
    }).drop("all_tokens")


def query_terms(routed: DataFrame, key: str) -> DataFrame:
    """(query_id, group_id, term) of a routed question: one group per kept token, its synonyms beside it; what ``bm25_scores`` takes."""
    table = F.create_map(*[c for k, v in SYNONYMS.items() for c in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    x = routed.select(F.col(key).alias("query_id"), F.posexplode("kept").alias("group_id", "t"))
    words = F.concat(F.array("t"), F.coalesce(F.try_element_at(table, F.col("t")), F.array().cast("array<string>")))
    return x.select("query_id", "group_id", F.explode(words).alias("term")).groupBy("query_id", "term").agg(F.min("group_id").alias("group_id")).select("query_id", "group_id", "term")


def relaxed(text: Column) -> Column:
    """Any-of query of a question: its tokens and the parts of snake_case names, once each and quoted."""
    t = tokens(text)
    parts = F.flatten(F.transform(t, lambda x: F.concat(F.array(x), F.when(x.contains("_"), F.filter(F.split(x, "_"), lambda p: p != "")).otherwise(F.array().cast("array<string>")))))
    return F.array_join(F.transform(F.array_distinct(parts), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " OR ")


def path_terms(path: Column) -> Column:
    """Latin letters and digits of a path as terms."""
    return F.filter(F.split(F.lower(F.regexp_replace(path, "[^0-9A-Za-z]+", " ")), " "), lambda x: x != "")


def phrase_documents(rows: DataFrame, key: str, text: str, phrase: str) -> DataFrame:
    """Keys whose text holds the words of a phrase one after the other: an any-order filter first, then the order."""
    words = phrase.lower().split()
    t = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)
    near = F.lower(F.col(text))
    for w in words:
        rows = rows.where(near.contains(w))
    joined = F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    return rows.where(joined.contains(" " + " ".join(words) + " ")).select(key).distinct()


def human_size(size: Column) -> Column:
    """Bytes as ``1.5 KB`` and so on, in steps of 1024."""
    out = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for i, unit in enumerate(("KB", "MB", "GB"), 1):
        last = unit == "GB"
        value = F.concat(F.format_number(size / float(1024**i), 2), F.lit(f" {unit}"))
        out = out.otherwise(value) if last else out.when(size < 1024 ** (i + 1), value)
    return out


def parse_size(text: Column) -> Column:
    """Bytes of ``10``, ``10 KB``, ``1.5m``; null if it is none."""
    t = F.lower(F.trim(text))
    number, unit = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)\s*([kmgt]?)(?:i?b)?$", 1), F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)\s*([kmgt]?)(?:i?b)?$", 2)
    factor = F.pow(F.lit(1024.0), F.when(unit == "", 0).otherwise(F.instr(F.lit("kmgt"), unit)))
    return F.when(number != "", F.floor(number.try_cast("double") * factor).cast("long"))


def remote_name(url: Column) -> Column:
    """``owner/name`` of a remote address in any spelling; null if it is none."""
    return F.nullif(F.lower(F.regexp_extract(F.regexp_replace(F.trim(url), r"(\.git)?/*$", ""), r"(?:^[a-z+]+://(?:[^/@]+@)?[^/:]+(?::\d+)?/|^[^@/]+@[^:/]+:)([^/]+/[^/]+)$", 1)), F.lit(""))


def fair_interleave(rows: DataFrame, query: str, score: str, language: str, tie: str) -> DataFrame:
    """Order by score, and among equal scores by turns of the languages."""
    turn = F.row_number().over(Window.partitionBy(query, score, language).orderBy(tie))
    x = rows.withColumn("turn", turn)
    return x.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), "turn", F.col(language).asc_nulls_last(), tie)))


def first_occurrence(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in a stated order."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def gate(old: DataFrame, new: DataFrame, least_gain: float = 0.0) -> DataFrame:
    """Two reports (metric, value) side by side: which metrics are held, and whether all are."""
    x = old.select("metric", F.col("value").alias("base")).join(new.select("metric", F.col("value").alias("candidate")), "metric", "full")
    x = x.withColumn("held", F.coalesce(F.col("candidate") >= F.col("base") + least_gain, F.lit(False)))
    return x.withColumn("promoted", F.bool_and("held").over(Window.partitionBy(F.lit(1))))
