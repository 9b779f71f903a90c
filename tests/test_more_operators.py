"""Path rules, planning, evidence, kept index and atlas on small tables with known answers."""

from __future__ import annotations

import hashlib
import itertools
import random

from pyspark.sql import functions as F

from lodestar.operators import evidence as V
from lodestar.operators import inventory as I
from lodestar.operators import kept as K
from lodestar.operators import paths as P
from lodestar.operators import planning as Q
from lodestar.operators import retrieval as R
from lodestar.operators import selection as S
from lodestar.operators import vectors as C


def test_path_classes(spark):
    want = {
        "src/core/a.py": ("core", "product", "core", "", False), "tests/test_a.py": ("guards", "test", "test", "test", False), "x/fixtures/test_b.py": ("guards", "fixture", "test", "", False),
        "tools/run_me.sh": ("entrypoints", "script", "infra", "", False), "contracts/a.schema.json": ("data_models", "product", "contract", "contract", False), "web/node_modules/p/i.js": ("ui", "product", "unknown", "", True),
        "pkg/retrieval/q.rs": ("core", "product", "retrieval", "retrieval", False), "Cargo.lock": ("core", "product", "unknown", "", True), "docs/README.md": ("entrypoints", "product", "unknown", "", False),
    }
    rows = P.classify(spark.createDataFrame([(p,) for p in [*want, None]], "path string")).collect()
    assert {r.path: (r.lens, r.projection, r.architecture_layer, r.facets, r.noise) for r in rows if r.path} == want
    readme = next(r for r in rows if r.path == "docs/README.md")
    assert readme.priority and readme.critical and readme.roles == "doc-essential" and readme.trust == "documentation"
    assert next(r for r in rows if r.path is None).lens is None


def test_glob_pattern():
    import re

    g = re.compile(P.glob_pattern(["**/fixtures/**", "*.min.js", "build/*.py", "node_modules", "d?c/x"]))
    yes = ["a/fixtures/b/c", "fixtures/x", "a/b.min.js", "build/a.py", "q/node_modules/z/y.js", "doc/x"]
    no = ["build/a/b.py", "fixture/x", "a.min.jsx", "node_modules2/x", "dooc/x"]
    assert [p for p in yes + no if g.match(p)] == yes


def test_routing(spark):
    rows = [("a", "Where is the index?"), ("b", "how do"), ("c", "security or auth"), ("d", None), ("e", "run the test")]
    got = {r.k: r for r in Q.route(spark.createDataFrame(rows, "k string, query_text string")).collect()}
    assert got["a"].fts_query == "the AND (index OR indexing OR build_index OR indexer)" and got["a"].synonyms == "build_index,indexer,indexing"
    assert got["b"].fts_query == "how AND do" and got["c"].intent == "security" and '"or"' in got["c"].fts_query
    assert got["d"].fts_query == "" and got["d"].intent == "unknown" and got["e"].intent == "entrypoint"
    terms = Q.query_terms(Q.route(spark.createDataFrame(rows[:1], "k string, query_text string")), "k").collect()
    assert {(r.group_id, r.term) for r in terms} == {(0, "the"), (1, "index"), (1, "indexing"), (1, "build_index"), (1, "indexer")}


def test_sizes_and_names(spark):
    df = spark.createDataFrame([(0,), (1023,), (1536,), (5 << 20,), (3 << 30,), (None,)], "n long")
    assert [r.s for r in df.select(Q.human_size(F.col("n")).alias("s")).collect()] == ["0 B", "1023 B", "1.50 KB", "5.00 MB", "3.00 GB", None]
    t = spark.createDataFrame([("10",), ("10 KB",), ("1.5m",), ("x",), (None,)], "t string")
    assert [r.s for r in t.select(Q.parse_size(F.col("t")).alias("s")).collect()] == [10, 10240, 1572864, None, None]
    u = spark.createDataFrame([("https://h.example/Own/Name.git",), ("git@h.example:own/name",), ("ssh://u@h.example:22/own/name/",), ("nothing",)], "u string")
    assert [r.s for r in u.select(Q.remote_name(F.col("u")).alias("s")).collect()] == ["own/name"] * 3 + [None]
    p = spark.createDataFrame([("see build_index now",)], "t string").select(Q.relaxed(F.col("t")).alias("s")).first().s
    assert p == '"see" OR "build_index" OR "build" OR "index" OR "now"'


def test_phrase_and_fair_order(spark):
    d = spark.createDataFrame([(1, "Read  back, it is"), (2, "back read"), (3, "ready back"), (4, None)], "k int, t string")
    assert [r.k for r in Q.phrase_documents(d, "k", "t", "read back").collect()] == [1]
    rows = [("q", 2, "py", "a"), ("q", 2, "py", "b"), ("q", 2, "go", "c"), ("q", 3, "py", "d"), ("q", 2, None, "e")]
    out = Q.fair_interleave(spark.createDataFrame(rows, "q string, s int, l string, k string"), "q", "s", "l", "k").orderBy("rank").collect()
    assert [r.k for r in out] == ["d", "c", "a", "e", "b"]


def test_hydration(spark):
    text = "grün\nblau\n"
    data = text.encode()
    files = spark.createDataFrame([("r", "a", text)], "repo_id string, path string, content string")
    sha = hashlib.sha256(data[0:6]).hexdigest()
    rows = [("1", "r", "a", 0, 6, sha.upper()), ("2", "r", "a", 0, 5, sha), ("3", "r", "a", 5, 5, sha), ("4", "r", "a", 0, 99, sha), ("5", "r", "b", 0, 6, sha), ("6", "r", "a", None, 6, sha)]
    got = {r.k: (r.range_status, r.text) for r in V.hydrate(spark.createDataFrame(rows, "k string, repo_id string, path string, start_byte long, end_byte long, sha256 string"), files).collect()}
    assert got == {"1": ("ok", "grün\n"), "2": ("mismatch", None), "3": ("bad_range", None), "4": ("bad_range", None), "5": ("no_file", None), "6": ("bad_range", None)}


def test_citations(spark):
    c = spark.createDataFrame([("c1", "r", "a", 1, 5, "x"), ("c2", "r", "a", 6, 9, "y"), ("c3", "r", "b", 1, 2, "z")], "chunk_id string, repo_id string, path string, start_line int, end_line int, content string")
    cit = V.citation_map(c)
    hits = spark.createDataFrame([("h1", "c1", "r", "a", 1, 5), ("h2", "old", "r", "a", 6, 9), ("h3", "c3", "r", "b", 2, 2), ("h4", "no", "r", "q", 1, 1)], "hit_id string, chunk_id string, repo_id string, path string, start_line int, end_line int")
    cand = V.citation_candidates(hits, cit)
    assert {r.hit_id: r.reasons for r in cand.collect()} == {"h1": "chunk_id,range", "h2": "range", "h3": "chunk_id"}
    assert {r.status: (r.n_hits, r.share) for r in V.range_coverage(hits, cand).collect()} == {"exact": (1, 0.25), "by_range_only": (1, 0.25), "by_id_only": (1, 0.25), "none": (1, 0.25)}
    new = V.citation_map(c.withColumn("content", F.when(F.col("chunk_id") == "c2", "changed").otherwise(F.col("content"))).where("chunk_id <> 'c3'"))
    d = V.drift(cit, new)
    assert sorted(r.drift_status for r in d.collect()) == ["drifted", "missing", "valid"]
    assert [(r.repo_id, r.worst, r.n) for r in V.worst_status(d, "repo_id", "drift_status").collect()] == [("r", "drifted", 3)]
    twice = cit.unionByName(cit)
    assert {r.citation_status for r in V.validate_citations(twice).collect()} == {"duplicate_id"}


def test_kept_index_updates_like_a_whole_build(spark, tmp_path):
    old = spark.createDataFrame([("a", "red green"), ("b", "blue"), ("c", None), ("d", "gone"), ("a", "red green")], "doc string, text string")
    new = spark.createDataFrame([("a", "red green"), ("b", "blue sky"), ("c", None), ("e", "red red")], "doc string, text string")
    first = K.build(old, str(tmp_path / "1"))
    assert {r.doc: r.state for r in K.states(first.docs, K.digests(new)).collect()} == {"a": "reused", "b": "changed", "c": "reused", "d": "deleted", "e": "added"}
    second, whole = K.update(first, new, str(tmp_path / "2")), K.build(new, str(tmp_path / "3"))
    for a, b in ((second.postings, whole.postings), (second.lengths, whole.lengths), (second.docs, whole.docs)):
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    q = spark.createDataFrame([("q", 1, "red")], "query_id string, group_id int, term string")
    assert {(r.doc, r.score) for r in second.scores(q).collect()} == {(r.doc, r.score) for r in R.bm25_scores(R.postings(new, "doc", "text"), q).collect()}


def test_kept_index_follows_its_source(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "shared_folder", lambda s: str(tmp_path))
    src = str(tmp_path / "src")
    spark.createDataFrame([("a", "red")], "doc string, text string").write.parquet(src)
    made = []
    real = K.build
    monkeypatch.setattr(K, "build", lambda d, p: made.append(p) or real(d, p))
    for _ in range(2):
        t = spark.read.parquet(src)
        assert K.kept("t", t, t).postings.count() == 1
    spark.createDataFrame([("b", "blue")], "doc string, text string").write.mode("append").parquet(src)
    t = spark.read.parquet(src)
    assert K.kept("t", t, t).postings.count() == 2 and len(made) == 2


def test_recursive_hashes(spark):
    rows = [("s", "a/b/x", 1, "p"), ("s", "a/b/y", 2, None), ("s", "a/z", 3, "q"), ("s", "w", 4, "r"), ("t", "a/b/x", 1, "p"), ("t", "a/b/y", 2, None), ("t", "a/z", 9, "q"), ("t", "w", 4, "r")]
    got = {(r.sid, r.dir): (r.n_entries, r.hash) for r in I.recursive_hashes(spark.createDataFrame(rows, "sid string, path string, size long, sum string")).collect()}
    assert {k: v[0] for k, v in got.items() if k[0] == "s"} == {("s", ""): 2, ("s", "a"): 2, ("s", "a/b"): 2}
    assert got["s", "a/b"] == got["t", "a/b"] and got["s", "a"] != got["t", "a"] and got["s", ""] != got["t", ""]


def test_first_fit_against_brute_force(spark):
    r = random.Random(2)
    rows = [(f"r{i % 3}", r.randrange(4), r.choice([1, 2, 5, 9, 30, None]), f"i{i}") for i in range(120)]
    want = {}
    for k in ("r0", "r1", "r2"):
        used, ids = 0, []
        for _, t, i in sorted((p, t, i) for q, p, t, i in rows if q == k and t is not None):
            if used + t <= 60:
                used, ids = used + t, [*ids, i]
        want[k] = ids
    got = S.first_fit(spark.createDataFrame(rows, "k string, priority int, tokens long, id string"), "k", 60).orderBy("pos").collect()
    assert {k: [r.id for r in got if r.k == k] for k in want} == want


def test_cosine_in_blocks_equals_brute_force(spark):
    r = random.Random(4)
    v = {i: [r.uniform(-1, 1) for _ in range(5)] for i in range(60)} | {99: [0.0] * 5}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    norm = lambda a: dot(a, a) ** 0.5 or 1.0
    q = spark.createDataFrame([(i, v[i]) for i in (0, 7, 99)], "query_id int, q array<double>")
    rows = spark.createDataFrame([*v.items(), (100, [1.0])], "row_id int, v array<double>")
    want = {i: sorted((-round(dot(v[i], v[j]) / norm(v[i]) / norm(v[j]), 6) + 0.0, j) for j in v if j != i)[:4] for i in (0, 7, 99)}
    for block in (1, 100):
        got = C.cosine_top_k(q, rows, 4, block).orderBy("rank").collect()
        assert {i: [(-g.score + 0.0, g.row_id) for g in got if g.query_id == i] for i in want} == want


def test_fingerprint_sees_repeats(spark):
    rows = lambda xs: spark.createDataFrame([(x,) for x in xs], "a string")
    f = lambda xs: R.signature(rows(xs), "a").first().fingerprint
    assert f("aab") != f("bcc") and f("ab") == f("ba") and len({f(x) for x in itertools.chain(["a", "aa", "aaa"])}) == 3


def test_structures(spark):
    from lodestar.operators import structures as X

    files = spark.createDataFrame([("r", "a.sh", "run() {\n  x\n}\nfunction b:c () {\n# no() is named\n"), ("r", "b.rs", 'pub async fn go() {}\n// fn not()\nlet s = "\\n fn no() //";\npub(crate) struct S;\n'), ("r", "n.sh", None)], "repo_id string, path string, content string")
    assert {(r.line_no, r.name) for r in X.bash_functions(files).collect()} == {(1, "run"), (4, "b:c")}
    assert {(r.line_no, r.kind, r.name) for r in X.rust_items(files).collect()} == {(1, "fn", "go"), (4, "struct", "S")}
    e = lambda xs: spark.createDataFrame(xs, "src string, dst string")
    q = X.edge_quality(e([("a", "b"), ("a", "c")]), e([("c", "a"), ("x", "x")]), e([("a", "b"), ("c", "a")])).first()
    assert (q.n_expected, q.n_found, q.recall, q.n_forbidden) == (2, 1, 0.5, 1)
