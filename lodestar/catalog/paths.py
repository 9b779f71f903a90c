"""Path rules and what they add up to."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import paths as P
from ..operators import texts as T
from .retrieval import chunks

EXCLUDED = ("**/fixtures/**", "vendor/**", "*.min.js", "node_modules", "build/*.py", "d?ps/**")
MOST_BYTES = 1000


def _files(spark, base):
    c = chunks(spark, base, "repo_id", "path", "chunk_id", "content")
    return c.where("path is not null").groupBy("repo_id", "path").agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("size"))


def _classed(spark, base):
    rows = P.classify(_files(spark, base))
    return rows.withColumn("category", T.path_class()["category"])


def path_lens(spark, base):
    return _classed(spark, base).select("repo_id", "path", "lens")


def lens_counts(spark, base):
    return _classed(spark, base).groupBy("repo_id", "lens").agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))


def path_projection(spark, base):
    return _classed(spark, base).select("repo_id", "path", "projection", "architecture_layer", "semantic_layer", "path_artifact_type")


def layer_unknown_share(spark, base):
    """Share of files without a known layer, per projection."""
    r = _classed(spark, base).groupBy("projection").agg(F.count("*").alias("n_files"), F.count_if(F.col("architecture_layer") == "unknown").alias("n_unknown"))
    return r.withColumn("unknown_share", F.round(F.col("n_unknown") / F.col("n_files"), 6))


def path_facets(spark, base):
    r = _classed(spark, base).where("facets <> ''").select("path", F.explode(F.split("facets", ",")).alias("facet")).distinct()
    return r.groupBy("facet").agg(F.count("*").alias("n_paths"))


def path_roles(spark, base):
    return _classed(spark, base).select("repo_id", "path", "roles", "trust", "noise", "priority", "critical")


def inclusion_status(spark, base):
    r = _classed(spark, base)
    return r.select("repo_id", "path", *[F.expr(P.inclusion(level, MOST_BYTES)).alias(level) for level in ("overview", "summary", "dev", "max", "full")])


def epistemic_metrics(spark, base):
    """How much of each repository a report at level ``dev`` shows in full, in rounded shares, and the risk that follows."""
    r = _classed(spark, base).withColumn("status", F.expr(P.inclusion("dev", MOST_BYTES)))
    r = r.groupBy("repo_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "full").alias("n_full"), F.count_if(F.col("status") == "meta-only").alias("n_meta"))
    share = F.round(F.col("n_full") / F.col("n"), 2)
    return r.withColumns({"full_share": share, "risk": F.when(share >= 0.8, "low").when(share >= 0.5, "medium").otherwise("high")})


def repo_health(spark, base):
    """Category counts and flags of each repository, and a status from them."""
    r = _classed(spark, base).groupBy("repo_id").agg(
        F.count("*").alias("n_files"), F.count_if(F.col("category") == "doc").alias("n_doc"), F.count_if(F.col("category") == "test").alias("n_test"), F.count_if(F.col("category") == "source").alias("n_source"),
        F.bool_or(F.expr("array_contains(parts, '.github')")).alias("has_ci"), F.bool_or("critical").alias("has_critical"), F.count_if("noise").alias("n_noise"),
    )
    status = F.when((F.col("n_doc") == 0) | (F.col("n_test") == 0), "warn").otherwise("ok")
    return r.withColumns({"test_share": F.round(F.col("n_test") / F.greatest(F.col("n_source"), F.lit(1)), 4), "status": status})


def fleet_consistency(spark, base):
    """Which flags all repositories agree on."""
    h = repo_health(spark, base)
    return h.agg(F.count("*").alias("n_repos"), F.count_if("has_ci").alias("n_ci"), F.count_if(F.col("status") == "ok").alias("n_ok"), F.sum("n_files").alias("n_files"))


def repo_roles(spark, base):
    r = chunks(spark, base, "repo_id").distinct()
    low = F.lower("repo_id")
    roles = F.concat_ws(" / ", *[F.when(F.greatest(*[low.contains(w) for w in words], F.lit(False)), role) for role, words in P.REPO_ROLES.items()])
    return r.select("repo_id", F.when(roles == "", "service").otherwise(roles).alias("role"))


def folder_kinds(spark, base):
    """Folders of each repository by what stands in them: code, documents, infrastructure."""
    kind = F.when(F.col("category").isin("source", "test"), "code").when(F.col("category") == "doc", "doc").otherwise("infra")
    folder = F.when(F.size("parts") > 1, F.get("parts", F.lit(0))).otherwise("")
    return _classed(spark, base).groupBy("repo_id", folder.alias("folder")).agg(F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"), F.count("*").alias("n_files"))


def folder_heat(spark, base):
    """The five folders with most files of each repository."""
    from ..operators.retrieval import top_k

    folder = F.regexp_replace("path", "/?[^/]*$", "")
    r = _files(spark, base).groupBy("repo_id", folder.alias("folder")).agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))
    return top_k(r, 5, ["repo_id"], [F.desc("n_files"), F.desc("n_bytes"), F.col("folder")]).select("repo_id", "rank", "folder", "n_files", "n_bytes")


def exclude_globs(spark, base):
    return _files(spark, base).where(F.col("path").rlike(P.glob_pattern(EXCLUDED))).select("repo_id", "path")


def concept_hits(spark, base):
    c = chunks(spark, base, "chunk_id", "language", "content").where("content is not null")
    r = c.select("language", F.explode(F.split(P.concepts(F.col("content")), ",")).alias("concept")).where("concept <> ''")
    return r.groupBy("language", "concept").agg(F.count("*").alias("n_chunks"))


QUERIES = {f.__name__: f for f in (
    path_lens, lens_counts, path_projection, layer_unknown_share, path_facets, path_roles, inclusion_status, epistemic_metrics, repo_health, fleet_consistency, repo_roles, folder_kinds, folder_heat, exclude_globs, concept_hits)}

_LAYER = "coalesce(" + P.first_of(P.layer_rules()) + ", list_filter(list_transform(parts, lambda p: CASE p " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.LAYER_OF_FOLDER.items()) + " END), lambda x: x IS NOT NULL)[1], CASE WHEN " + P.first_of(P.PROJECTIONS) + " = 'script' THEN 'infra' END, 'unknown')"
_F = """WITH c AS (SELECT DISTINCT chunk_id, repo_id, path, language, content FROM chunks),
f0 AS (SELECT repo_id, path, coalesce(sum(strlen(content)), 0) AS size, string_split(replace(path, chr(92), '/'), '/') AS parts FROM (SELECT DISTINCT repo_id, path, chunk_id, content FROM c) WHERE path IS NOT NULL GROUP BY repo_id, path),
f1 AS (SELECT *, list_transform(parts[1:-2], lambda p: lower(p)) AS dirs, lower(parts[-1]) AS name, lower(path) AS whole FROM f0),
f2 AS (SELECT *, regexp_extract(name, '^.+(\\.[^.]+)$', 1) AS ext FROM f1)"""
_CATEGORY = """CASE WHEN (name IN ({names}) OR array_contains(parts, 'config') OR array_contains(parts, '.github') OR array_contains(parts, '.wgx') OR ext IN ({config})) THEN CASE WHEN array_contains(parts, 'contracts') THEN 'contract' ELSE 'config' END
WHEN ext IN ({docs}) OR array_contains(parts, 'docs') THEN 'doc' WHEN array_contains(parts, 'contracts') THEN 'contract'
WHEN array_contains(parts, 'tests') OR array_contains(parts, 'test') OR name LIKE '%!_test.py' ESCAPE '!' OR name LIKE 'test!_%' ESCAPE '!' THEN 'test'
WHEN ext IN ({source}) OR array_contains(parts, 'src') OR array_contains(parts, 'crates') OR array_contains(parts, 'scripts') THEN 'source' ELSE 'other' END""".format(
    names=", ".join(f"'{n}'" for n in T.CONFIG_NAMES), config=", ".join(f"'{e}'" for e in T.CONFIG_EXTENSIONS), docs=", ".join(f"'{e}'" for e in T.DOC_EXTENSIONS), source=", ".join(f"'{e}'" for e in T.SOURCE_EXTENSIONS))
_K = _F + f",\nk AS (SELECT *, {P.first_of(P.LENSES)} AS lens, {P.first_of(P.PROJECTIONS)} AS projection, {_LAYER} AS architecture_layer, {P.first_of(P.SEMANTIC_LAYERS)} AS semantic_layer, {P.first_of(P.ARTIFACT_TYPES)} AS path_artifact_type, {P.all_of(P.FACETS)} AS facets, {P.all_of(P.ROLES)} AS roles, {P.first_of(P.TRUST_CLASSES)} AS trust, {P.NOISE} AS noise, {P.PRIORITY} AS priority, {P.CRITICAL} AS critical, {_CATEGORY} AS category FROM f2)"
_HEALTH = _K + """, h AS (SELECT repo_id, count(*) AS n_files, count(*) FILTER (WHERE category = 'doc') AS n_doc, count(*) FILTER (WHERE category = 'test') AS n_test, count(*) FILTER (WHERE category = 'source') AS n_source, bool_or(array_contains(parts, '.github')) AS has_ci, bool_or(critical) AS has_critical,
count(*) FILTER (WHERE noise) AS n_noise FROM k GROUP BY 1), hh AS (SELECT *, round(n_test / greatest(n_source, 1), 4) AS test_share, CASE WHEN n_doc = 0 OR n_test = 0 THEN 'warn' ELSE 'ok' END AS status FROM h)"""
SQL = {
    "path_lens": _K + " SELECT repo_id, path, lens FROM k",
    "lens_counts": _K + " SELECT repo_id, lens, count(*) AS n_files, sum(size) AS n_bytes FROM k GROUP BY 1, 2",
    "path_projection": _K + " SELECT repo_id, path, projection, architecture_layer, semantic_layer, path_artifact_type FROM k",
    "layer_unknown_share": _K + " SELECT projection, count(*) AS n_files, count(*) FILTER (WHERE architecture_layer = 'unknown') AS n_unknown, round(count(*) FILTER (WHERE architecture_layer = 'unknown') / count(*), 6) AS unknown_share FROM k GROUP BY 1",
    "path_facets": _K + " SELECT facet, count(*) AS n_paths FROM (SELECT DISTINCT path, unnest(string_split(facets, ',')) AS facet FROM k WHERE facets <> '') GROUP BY 1",
    "path_roles": _K + " SELECT repo_id, path, roles, trust, noise, priority, critical FROM k",
    "inclusion_status": _K + " SELECT repo_id, path, " + ", ".join(f"{P.inclusion(level, MOST_BYTES)} AS \"{level}\"" for level in ("overview", "summary", "dev", "max", "full")) + " FROM k",
    "epistemic_metrics": _K + f""", s AS (SELECT repo_id, {P.inclusion('dev', MOST_BYTES)} AS status FROM k), g AS (SELECT repo_id, count(*) AS n, count(*) FILTER (WHERE status = 'full') AS n_full, count(*) FILTER (WHERE status = 'meta-only') AS n_meta FROM s GROUP BY 1)
SELECT *, round(n_full / n, 2) AS full_share, CASE WHEN round(n_full / n, 2) >= 0.8 THEN 'low' WHEN round(n_full / n, 2) >= 0.5 THEN 'medium' ELSE 'high' END AS risk FROM g""",
    "repo_health": _HEALTH + " SELECT * FROM hh",
    "fleet_consistency": _HEALTH + " SELECT count(*) AS n_repos, count(*) FILTER (WHERE has_ci) AS n_ci, count(*) FILTER (WHERE status = 'ok') AS n_ok, sum(n_files) AS n_files FROM hh",
    "repo_roles": "SELECT repo_id, CASE WHEN r = '' THEN 'service' ELSE r END AS role FROM (SELECT repo_id, concat_ws(' / ', " + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(repo_id), '{w}')" for w in ws) + f" THEN '{r}' END" for r, ws in P.REPO_ROLES.items()) + ") AS r FROM (SELECT DISTINCT repo_id FROM chunks))",
    "folder_kinds": _K + " SELECT repo_id, CASE WHEN len(parts) > 1 THEN parts[1] ELSE '' END AS folder, array_to_string(list_sort(list(DISTINCT CASE WHEN category IN ('source', 'test') THEN 'code' WHEN category = 'doc' THEN 'doc' ELSE 'infra' END)), ',') AS kinds, count(*) AS n_files FROM k GROUP BY 1, 2",
    "folder_heat": _F + """ SELECT * FROM (SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY n_files DESC, n_bytes DESC, folder) AS rank, folder, n_files, n_bytes FROM (SELECT repo_id, regexp_replace(path, '/?[^/]*$', '') AS folder, count(*) AS n_files, sum(size) AS n_bytes FROM f0 GROUP BY 1, 2)) WHERE rank <= 5""",
    "exclude_globs": _F + f" SELECT repo_id, path FROM f0 WHERE regexp_matches(path, '{P.glob_pattern(EXCLUDED)}')",
    "concept_hits": "SELECT language, concept, count(*) AS n_chunks FROM (SELECT DISTINCT chunk_id, language, content FROM chunks WHERE content IS NOT NULL) CROSS JOIN (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in P.CONCEPTS.items()) + ") m(word, concept) WHERE contains(lower(content), word) GROUP BY 1, 2",
}
