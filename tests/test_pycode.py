"""Python graph on a small repository whose answers are known."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import pycode as P

FILES = {
    "src/app/__init__.py": "from .core import run\nfrom .base import Base as Root\n",
    "src/app/core.py": "import os\nfrom . import util\nfrom .util import helper as h\n\n\ndef run(x):\n    def inner():\n        return h(x)\n    os.getcwd()\n    print(x)\n    x()\n    util.other()\n    missing()\n    return inner()\n\n\nif __name__ == '__main__':\n    run(1)\n",
    "src/app/util.py": "def helper(a):\n    return other()\n\n\ndef other():\n    return 1\n",
    "src/app/base.py": "class Base:\n    def save(self):\n        return self.check()\n\n    def check(self):\n        return 1\n",
    "src/app/model.py": "from app import Root\nfrom .base import Base\n\n\nclass Model(Base):\n    def load(self):\n        self.save()\n        super().check()\n        self.gone()\n\n\nclass Sub(Model):\n    def go(self):\n        self.load()\n        self.check()\n",
    "tests/test_run.py": "from app import run\nimport app.util as u\n\n\ndef test_run():\n    run(2)\n    u.helper(1)\n",
    "bad.py": "def f(:\n",
    "a/twin.py": "def t(): pass\n", "lib/a/twin.py": "def t(): pass\n", "use.py": "from a.twin import t\nt()\n",
}


def _calls(spark):
    files = spark.createDataFrame([("r", p, t) for p, t in FILES.items()] + [("r", "n.py", None), ("q", "use.py", "run()\n")], "repo_id string, path string, content string")
    fact = P.facts(files)
    return files, fact, P.resolve_calls(fact, files).cache()


def test_calls_by_scope_import_and_inheritance(spark):
    _, _, calls = _calls(spark)
    got = {(r.repo_id, r.path.split("/")[-1], r.line, r.name): (r.status, r.reason, r.target_path, r.target_symbol) for r in calls.collect()}
    at = lambda f, line, name, repo="r": got[repo, f, line, name]
    assert at("core.py", 8, "h") == ("resolved", None, "src/app/util.py", "helper")
    assert at("core.py", 9, "os.getcwd")[:2] == ("external", "module_not_in_repository")
    assert at("core.py", 10, "print")[0] == "builtin"
    assert at("core.py", 11, "x")[:2] == ("dynamic", "dynamic_receiver")
    assert at("core.py", 12, "util.other") == ("resolved", None, "src/app/util.py", "other")
    assert at("core.py", 13, "missing")[:2] == ("unresolved", "unknown_name")
    assert at("core.py", 14, "inner")[3] == "run.inner"
    assert at("base.py", 3, "self.check")[2:] == ("src/app/base.py", "Base.check")
    assert at("model.py", 7, "self.save")[2:] == ("src/app/base.py", "Base.save")
    assert at("model.py", 8, "super().check")[2:] == ("src/app/base.py", "Base.check")
    assert at("model.py", 9, "self.gone")[:2] == ("unresolved", "no_such_method")
    assert at("model.py", 15, "self.check")[2:] == ("src/app/base.py", "Base.check")
    assert at("test_run.py", 6, "run")[2:] == ("src/app/core.py", "run")  # through the package's re-export
    assert at("test_run.py", 7, "u.helper")[2:] == ("src/app/util.py", "helper")
    assert at("use.py", 2, "t")[:2] == ("unresolved", "ambiguous_module")
    assert at("use.py", 1, "run", "q")[0] == "unresolved"  # never across repositories
    causes = {(r.status, r.reason): r.n_calls for r in P.unresolved_causes(calls).collect()}
    assert sum(causes.values()) == len(got) and causes["unresolved", "unknown_name"] == 2


def test_groups_cards_and_impact(spark):
    files, fact, calls = _calls(spark)
    edges = P.import_edges(fact, files)
    assert {(r.alias, r.resolution, r.target_path, r.target_symbol) for r in edges.where("path = 'src/app/core.py'").collect()} == {
        ("os", "external", None, None), ("util", "local_module", "src/app/util.py", None), ("h", "local", "src/app/util.py", "helper")}
    groups = {(r.target_symbol, r.path, r.caller): (r.n_sites, r.lines, r.caller_start) for r in P.caller_groups(calls, fact).collect()}
    assert groups["run", "tests/test_run.py", "test_run"] == (1, [6], 5) and groups["run", "src/app/core.py", ""] == (1, [18], None)
    assert {r.relations for r in P.callee_groups(calls).where("target_symbol = 'Base.check' and caller = 'Model.load'").collect()} == {"super"}
    changed = spark.createDataFrame([("r", "src/app/util.py")], "repo_id string, path string")
    hit = P.impact(P.relation_cards(calls, edges), changed, F.col("path").startswith("tests/"), fact.where("kind = 'entry'"))
    rows = {r.path: (r.relations, r.directions, r.is_entry, r.is_test) for r in hit.collect()}
    assert rows == {"src/app/core.py": ("calls,imports", "used_by", True, False), "tests/test_run.py": ("calls,imports", "used_by", False, True)}
    assert [(r.rank, r.path) for r in P.related_tests(hit, 3).collect()] == [(1, "tests/test_run.py")]
    assert P.facts(files.limit(0)).count() == 0
