"""Ranges, citations and the atlas of inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normal
from ..operators import evidence as V
from ..operators import inventory as I
from ..operators.retrieval import file_context, top_k
from ..sources.tables import table
from .inventory import _H, _held
from .retrieval import chunks

LAST_BATCH = 4  # the state before and after this batch is compared


def _citations(spark, base):
    return V.citation_map(chunks(spark, base, "chunk_id", "repo_id", "path", "start_line", "end_line", "content"))


def range_hydration(spark, base):
    c = chunks(spark, base, "chunk_id", "repo_id", "path", "start_line", "start_byte", "end_byte", "content_sha256", "content")
    rows = c.select("chunk_id", "repo_id", "path", "start_byte", "end_byte", normal.digest("content_sha256").alias("sha256"))
    return V.hydrate(rows, file_context(c)).groupBy("range_status").agg(F.count("*").alias("n_ranges"), F.sum(F.length("text")).alias("n_chars"))


def citation_map(spark, base):
    return _citations(spark, base).select("citation_id", "chunk_id", "sha256")


def citation_validation(spark, base):
    return V.validate_citations(_citations(spark, base)).groupBy("citation_status").agg(F.count("*").alias("n"))


def _hits(spark, base):
    """Hits as a search gives them: every chunk with a content; those of notes carry a stale chunk id, those of tests a shifted range."""
    c = chunks(spark, base, "chunk_id", "repo_id", "path", "start_line", "end_line", "language", "layer", "content").where("content is not null")
    old = F.when(F.col("language") == "markdown", F.concat(F.lit("old-"), F.col("chunk_id"))).otherwise(F.col("chunk_id"))
    return c.select(F.col("chunk_id").alias("hit_id"), old.alias("chunk_id"), "repo_id", "path", (F.col("start_line") + F.when(F.col("layer") == "test", 1).otherwise(0)).alias("start_line"), "end_line").distinct()


def hit_citations(spark, base):
    return V.citation_candidates(_hits(spark, base), _citations(spark, base))


def range_coverage(spark, base):
    h = _hits(spark, base)
    return V.range_coverage(h, V.citation_candidates(h, _citations(spark, base)))


def _states(spark, base):
    c = chunks(spark, base, "chunk_id", "repo_id", "path", "start_line", "end_line", "content", "batch_no")
    return V.citation_map(c.where(F.col("batch_no") <= LAST_BATCH)), V.citation_map(c.where(F.col("batch_no") > 0))


def citation_drift(spark, base):
    return V.drift(*_states(spark, base)).groupBy("drift_status").agg(F.count("*").alias("n"))


def worst_citation_status(spark, base):
    return V.worst_status(V.drift(*_states(spark, base)), "repo_id", "drift_status")


def bundle_parity(spark, base):
    """Files of the two largest repositories side by side, by path and digest."""
    f = file_context(chunks(spark, base, "chunk_id", "repo_id", "path", "start_line", "content"))
    f = f.select("repo_id", F.regexp_replace("path", "_[0-9a-z]{3}(\\.[a-z]+)$", "$1").alias("path"), F.md5(F.encode("content", "utf-8")).alias("digest"))
    f = f.groupBy("repo_id", "path").agg(F.min("digest").alias("digest"))
    two = [r["repo_id"] for r in f.groupBy("repo_id").count().orderBy(F.desc("count"), "repo_id").limit(2).collect()]
    two += [None] * (2 - len(two))
    return V.file_parity(f.where(F.col("repo_id").eqNullSafe(two[0])), f.where(F.col("repo_id").eqNullSafe(two[1])))


def backup_gap(spark, base):
    """What the last complete snapshot of a root holds and the last one of its machine's first root lacks or holds otherwise."""
    held = _held(spark, base).where("next_sid is null")
    roots = table(spark, base, "roots", "root_id", "machine_id").select(normal.key("root_id").alias("root"), normal.key("machine_id").alias("machine")).where("root is not null and machine is not null").distinct()
    of = roots.groupBy("root").agg(F.min("machine").alias("machine"))
    have = held.select("root").distinct().join(of, "root")
    backup = have.groupBy("machine").agg(F.min("root").alias("backup"))
    a = held.join(of, "root").join(backup, "machine").where("root <> backup").select("root", "backup", "path", "size", "mtime_at")
    b = held.select(F.col("root").alias("backup"), "path", F.col("size").alias("b_size"), F.lit(True).alias("there"))
    x = a.join(b, ["backup", "path"], "left").withColumn("gap", F.when(F.col("there").isNull(), "missing").when(~F.col("size").eqNullSafe(F.col("b_size")), "outdated"))
    return x.where("gap is not null").groupBy("root", "backup", "gap").agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))


def inventory_ranges(spark, base):
    """Extension, size and time ranges, both ends included; rows without a time fall out when a time is asked for."""
    h = _held(spark, base).withColumn("at", F.col("mtime_at").try_cast("bigint"))
    low, high = 1_735_689_600_000_000, 1_767_225_600_000_000  # 2025 in microseconds
    h = h.where((F.lower("path").rlike(r"\.(py|json|md)$")) & F.col("size").between(100, 20_000) & F.col("at").between(low, high))
    return h.select("sid", "path", "size", "at")


def directory_sizes(spark, base):
    """Subtree figures of every directory: files, direct files, folders, bytes."""
    h = _held(spark, base)
    r = I.ancestor_rollup(h).select("sid", "dir", "n_files", "n_bytes")
    folders = r.where("dir <> ''").select("sid", F.regexp_replace("dir", "/?[^/]+$", "").alias("dir")).groupBy("sid", "dir").agg(F.count("*").alias("n_folders"))
    direct = h.groupBy("sid", F.regexp_replace("path", "/?[^/]+$", "").alias("dir")).agg(F.count("*").alias("n_direct"))
    return r.join(folders, ["sid", "dir"], "left").join(direct, ["sid", "dir"], "left").select("sid", "dir", "n_files", "n_bytes", F.coalesce("n_folders", F.lit(0)).alias("n_folders"), F.coalesce("n_direct", F.lit(0)).alias("n_direct"))


def recursive_hashes(spark, base):
    return I.recursive_hashes(_held(spark, base, "checksum").withColumn("sum", normal.digest("checksum")))


def largest_files(spark, base):
    return _held(spark, base).orderBy(F.desc("size"), "sid", "path").limit(100).select("sid", "path", "size")


def top_extensions(spark, base):
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    r = _held(spark, base).groupBy(ext.alias("ext")).agg(F.count("*").alias("n"), F.sum("size").alias("n_bytes"))
    return r.orderBy(F.desc("n"), "ext").limit(50)


def oldest_files(spark, base):
    return I.disk_hotspots(_held(spark, base)).where("kind = 'oldest'").select("sid", "path", "size")


def scan_reuse(spark, base):
    """What a scan of the next snapshot may take over: same size and time, same quick hash, or nothing."""
    h = _held(spark, base, "quick_hash").withColumn("quick", normal.key("quick_hash"))
    prev = h.select(F.col("next_sid").alias("sid"), "path", F.col("size").alias("p_size"), F.col("mtime_at").alias("p_at"), F.col("quick").alias("p_quick"), F.lit(True).alias("there")).where("sid is not null")
    x = h.where("seq > 1").join(prev, ["sid", "path"], "left")
    same = F.col("size").eqNullSafe(F.col("p_size")) & F.col("mtime_at").eqNullSafe(F.col("p_at"))
    state = F.when(F.col("there").isNull(), "new").when(same, "reused").when((F.col("size") == F.col("p_size")) & (F.col("quick") == F.col("p_quick")), "same_content").otherwise("rehash")
    return x.groupBy("sid", state.alias("state")).agg(F.count("*").alias("n_files"))


def hot_spots(spark, base):
    """Eight files per snapshot by the weight of their kind plus up to one for their size."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    kind = F.when(name.rlike("^(readme|makefile|dockerfile)"), 5.0).when(name.rlike(r"^(main|index|__main__)\."), 3.0).when(name.rlike(r"\.(toml|yaml|yml|json)$"), 2.5).when(name.rlike(r"\.(py|rs|go|ts|js)$"), 1.5).otherwise(1.0)
    score = F.round(kind + F.least(F.coalesce(F.col("size"), F.lit(0)) / 100_000, F.lit(1.0)), 6)
    h = _held(spark, base).withColumn("score", score)
    return top_k(h, 8, ["sid"], [F.desc("score"), F.desc("size"), F.col("path")]).select("sid", "rank", "path", "score")


def snapshot_refs(spark, base):
    """Snapshots by reference: ``root:latest``, ``root:N`` (N-th from the first) or an id."""
    from ..operators.snapshots import complete_sequence

    s = complete_sequence(table(spark, base, "snapshots", "snapshot_id", "root_id", "created_at", "status", "ingested_at")).select("sid", "root", "seq", "next_sid")
    refs = s.select("root").distinct().select(F.explode(F.array(F.concat("root", F.lit(":latest")), F.concat("root", F.lit(":2")))).alias("ref")).unionByName(s.where("seq = 1").select(F.col("sid").alias("ref")))
    r = refs.select("ref", F.regexp_extract("ref", "^(.*):([^:]+)$", 1).alias("r_root"), F.regexp_extract("ref", "^(.*):([^:]+)$", 2).alias("which"))
    latest = r.where("which = 'latest'").join(s.where("next_sid is null"), F.col("r_root") == F.col("root")).select("ref", "sid")
    number = r.where("which rlike '^[0-9]+$'").join(s, (F.col("r_root") == F.col("root")) & (F.col("which").try_cast("int") == F.col("seq"))).select("ref", "sid")
    by_id = r.where("which = ''").join(s, F.col("ref") == F.col("sid")).select("ref", "sid")
    return latest.unionByName(number).unionByName(by_id)


QUERIES = {f.__name__: f for f in (
    range_hydration, citation_map, citation_validation, hit_citations, range_coverage, citation_drift, worst_citation_status, bundle_parity, backup_gap, inventory_ranges, directory_sizes,
    recursive_hashes, largest_files, top_extensions, oldest_files, scan_reuse, hot_spots, snapshot_refs)}

_CIT = """WITH k AS (SELECT DISTINCT chunk_id, repo_id, path, start_line, end_line, language, layer, content, batch_no FROM chunks),
cit AS (SELECT DISTINCT 'cit_' || substr(sha1(concat_ws(chr(10), repo_id, path, CAST(start_line AS VARCHAR), CAST(end_line AS VARCHAR), sha256(content))), 1, 16) AS citation_id, chunk_id, repo_id, path, start_line, end_line, sha256(content) AS sha256{extra} FROM k WHERE content IS NOT NULL)"""
_C1 = _CIT.format(extra="")
_HITS = _C1 + """, hits AS (SELECT DISTINCT chunk_id AS hit_id, CASE WHEN language = 'markdown' THEN 'old-' || chunk_id ELSE chunk_id END AS chunk_id, repo_id, path, start_line + CASE WHEN layer = 'test' THEN 1 ELSE 0 END AS start_line, end_line FROM k WHERE content IS NOT NULL),
cand AS (SELECT hit_id, citation_id, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM (SELECT hit_id, citation_id, 'chunk_id' AS reason FROM hits JOIN cit USING (chunk_id)
UNION SELECT hit_id, citation_id, 'range' FROM hits h JOIN cit c ON h.repo_id = c.repo_id AND h.path = c.path AND h.start_line = c.start_line AND h.end_line = c.end_line) GROUP BY 1, 2)"""
_DRIFT = _CIT.format(extra=", batch_no") + f""", o AS (SELECT DISTINCT citation_id, repo_id, path, start_line, sha256, chunk_id, end_line FROM cit WHERE batch_no <= {LAST_BATCH}), n AS (SELECT repo_id, path, start_line, list(DISTINCT sha256) AS shas FROM cit WHERE batch_no > 0 GROUP BY 1, 2, 3),
dr AS (SELECT o.citation_id, o.repo_id, o.path, CASE WHEN n.shas IS NULL THEN 'missing' WHEN list_contains(n.shas, o.sha256) THEN 'valid' ELSE 'drifted' END AS drift_status FROM o LEFT JOIN n USING (repo_id, path, start_line))"""
SQL = {
    "range_hydration": """WITH c AS (SELECT DISTINCT chunk_id, repo_id, path, start_line, start_byte, end_byte, content_sha256, content FROM chunks),
f AS (SELECT repo_id, path, encode(string_agg(coalesce(content, ''), '' ORDER BY start_line, chunk_id, coalesce(content, ''))) AS b FROM (SELECT DISTINCT repo_id, path, start_line, chunk_id, content FROM c) GROUP BY 1, 2),
r AS (SELECT DISTINCT chunk_id, repo_id, path, start_byte, end_byte, nullif(regexp_replace(lower(trim(content_sha256)), '^[a-z0-9-]+:', ''), '') AS sha, content FROM c),
x AS (SELECT r.*, b, start_byte IS NULL OR end_byte IS NULL OR start_byte < 0 OR end_byte <= start_byte OR end_byte > octet_length(b) AS bad FROM r LEFT JOIN f USING (repo_id, path)),
y AS (SELECT *, CASE WHEN NOT bad THEN b[start_byte + 1:end_byte] END AS piece FROM x),
z AS (SELECT CASE WHEN b IS NULL THEN 'no_file' WHEN bad THEN 'bad_range' WHEN sha256(piece) = sha THEN 'ok' ELSE 'mismatch' END AS range_status, piece FROM y)
SELECT range_status, count(*) AS n_ranges, sum(CASE WHEN range_status = 'ok' THEN length(decode(piece)) END) AS n_chars FROM z GROUP BY 1""",
    "citation_map": _C1 + " SELECT citation_id, chunk_id, sha256 FROM cit",
    "citation_validation": _C1 + """, v AS (SELECT *, count(*) OVER (PARTITION BY citation_id) AS n FROM cit) SELECT CASE WHEN n > 1 THEN 'duplicate_id' WHEN start_line IS NULL OR end_line IS NULL OR start_line < 1 OR end_line < start_line THEN 'bad_range' ELSE 'valid' END AS citation_status, count(*) AS n FROM v GROUP BY 1""",
    "hit_citations": _HITS + " SELECT * FROM cand",
    "range_coverage": _HITS + """, b AS (SELECT hit_id, bool_or(reasons = 'chunk_id,range') AS bt, bool_or(contains(reasons, 'chunk_id')) AS bi FROM cand GROUP BY 1), s AS (SELECT CASE WHEN bt THEN 'exact' WHEN bi THEN 'by_id_only' WHEN bi IS NOT NULL THEN 'by_range_only' ELSE 'none' END AS status FROM (SELECT DISTINCT hit_id FROM hits) LEFT JOIN b USING (hit_id))
SELECT status, count(*) AS n_hits, round(count(*) / (SELECT count(*) FROM s), 6) AS share FROM s GROUP BY 1""",
    "citation_drift": _DRIFT + " SELECT drift_status, count(*) AS n FROM dr GROUP BY 1",
    "worst_citation_status": _DRIFT + " SELECT repo_id, CASE max(CASE drift_status WHEN 'valid' THEN 1 WHEN 'missing' THEN 3 ELSE 4 END) WHEN 1 THEN 'valid' WHEN 3 THEN 'missing' ELSE 'drifted' END AS worst, count(*) AS n FROM dr GROUP BY 1",
    "bundle_parity": """WITH c AS (SELECT DISTINCT chunk_id, repo_id, path, start_line, content FROM chunks), f0 AS (SELECT repo_id, path, md5(string_agg(coalesce(content, ''), '' ORDER BY start_line, chunk_id, coalesce(content, ''))) AS d FROM c GROUP BY 1, 2),
f AS (SELECT repo_id, regexp_replace(path, '_[0-9a-z]{3}(\\.[a-z]+)$', '\\1') AS path, min(d) AS d FROM f0 GROUP BY 1, 2), t AS (SELECT repo_id, row_number() OVER (ORDER BY n DESC, repo_id) AS k FROM (SELECT repo_id, count(*) AS n FROM f GROUP BY 1)),
a AS (SELECT path, d FROM f JOIN t USING (repo_id) WHERE k = 1), b AS (SELECT path, d FROM f JOIN t USING (repo_id) WHERE k = 2)
SELECT CASE WHEN b.path IS NULL THEN 'only_left' WHEN a.path IS NULL THEN 'only_right' WHEN a.d = b.d THEN 'equal' ELSE 'different' END AS state, count(*) AS n_paths FROM a FULL JOIN b ON a.path = b.path GROUP BY 1""",
    "backup_gap": _H + """, l AS (SELECT * FROM h WHERE next_sid IS NULL), o AS (SELECT lower(trim(root_id)) AS root, min(lower(trim(machine_id))) AS machine FROM roots WHERE root_id IS NOT NULL AND machine_id IS NOT NULL GROUP BY 1),
bk AS (SELECT machine, min(root) AS backup FROM (SELECT DISTINCT root FROM l) JOIN o USING (root) GROUP BY 1), a AS (SELECT l.root, backup, path, size FROM l JOIN o USING (root) JOIN bk USING (machine) WHERE l.root <> backup),
x AS (SELECT a.*, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.size IS DISTINCT FROM b.size THEN 'outdated' END AS gap FROM a LEFT JOIN l b ON b.root = a.backup AND b.path = a.path) SELECT root, backup, gap, count(*) AS n_files, sum(size) AS n_bytes FROM x WHERE gap IS NOT NULL GROUP BY 1, 2, 3""",
    "inventory_ranges": _H + " SELECT sid, path, size, m AS at FROM h WHERE regexp_matches(lower(path), '\\.(py|json|md)$') AND size BETWEEN 100 AND 20000 AND m BETWEEN 1735689600000000 AND 1767225600000000",
    "directory_sizes": _H + """, p AS (SELECT sid, size, string_split(path, '/') AS parts FROM h), a AS (SELECT sid, size, parts, unnest(range(len(parts))) AS i FROM p),
r AS (SELECT sid, array_to_string(parts[1:i], '/') AS dir, count(*) AS n_files, sum(size) AS n_bytes, count(*) FILTER (WHERE i = len(parts) - 1) AS n_direct FROM a GROUP BY 1, 2),
fo AS (SELECT sid, regexp_replace(dir, '/?[^/]+$', '') AS dir, count(*) AS n_folders FROM r WHERE dir <> '' GROUP BY 1, 2) SELECT sid, dir, n_files, n_bytes, coalesce(n_folders, 0) AS n_folders, n_direct FROM r LEFT JOIN fo USING (sid, dir)""",
    "largest_files": _H + " SELECT sid, path, size FROM h ORDER BY size DESC NULLS LAST, sid, path LIMIT 100",
    "top_extensions": _H + " SELECT lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS ext, count(*) AS n, sum(size) AS n_bytes FROM h GROUP BY 1 ORDER BY n DESC, ext LIMIT 50",
    "oldest_files": _H + " SELECT sid, path, size FROM h WHERE m IS NOT NULL ORDER BY m, sid, path LIMIT 50",
    "hot_spots": _H + """, s AS (SELECT sid, path, size, round(CASE WHEN regexp_matches(nm, '^(readme|makefile|dockerfile)') THEN 5.0 WHEN regexp_matches(nm, '^(main|index|__main__)\\.') THEN 3.0 WHEN regexp_matches(nm, '\\.(toml|yaml|yml|json)$') THEN 2.5 WHEN regexp_matches(nm, '\\.(py|rs|go|ts|js)$') THEN 1.5 ELSE 1.0 END + least(coalesce(size, 0) / 100000, 1.0), 6) AS score
FROM (SELECT *, lower(split_part(path, '/', -1)) AS nm FROM h)) SELECT * FROM (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY score DESC, size DESC NULLS LAST, path) AS rank, path, score FROM s) WHERE rank <= 8""",
    "snapshot_refs": _H + " SELECT root || ':latest' AS ref, sid FROM seq WHERE root IS NOT NULL AND next_sid IS NULL UNION ALL SELECT root || ':2', sid FROM seq WHERE seq = 2 UNION ALL SELECT sid, sid FROM seq WHERE seq = 1",
}
SQL["scan_reuse"] = SQL["largest_files"].split(" SELECT sid, path, size FROM h")[0].replace("size_bytes AS size, entry_id, ingested_at,", "size_bytes AS size, entry_id, ingested_at, lower(trim(quick_hash)) AS quick,").replace("seq.next_sid, f.size, f.m FROM f", "seq.next_sid, f.size, f.m, f.quick FROM f") + """
SELECT b.sid, CASE WHEN a.sid IS NULL THEN 'new' WHEN a.size IS NOT DISTINCT FROM b.size AND a.m IS NOT DISTINCT FROM b.m THEN 'reused' WHEN a.size = b.size AND a.quick = b.quick THEN 'same_content' ELSE 'rehash' END AS state, count(*) AS n_files
FROM h b LEFT JOIN h a ON a.next_sid = b.sid AND a.path = b.path WHERE b.seq > 1 GROUP BY 1, 2"""
