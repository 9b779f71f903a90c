import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 70


def test_nothing_outside_imports_the_llm_package():
    for p in (ROOT / "lodestar").rglob("*.py"):
        if "llm" in p.parts:
            continue
        for n in ast.walk(ast.parse(p.read_text())):
            names = [n.module or ""] if isinstance(n, ast.ImportFrom) else [a.name for a in n.names] if isinstance(n, ast.Import) else []
            assert not any("llm" in x.split(".") for x in names), p


def test_flagship(spark):
    assert entry.entry(spark).columns == ["snapshot_id", "rel_path", "change_kind"]
