"""What a path tells about a file: noise, inclusion, roles, lens, facets, layers.

A rule is a result and a condition over the columns that ``path_columns`` adds: ``parts`` (folders and
name), ``dirs`` (folders only), ``name`` and ``whole`` (lower case), ``ext`` (lower case, with its dot).
Conditions are built from the value lists below as plain SQL, so every rule is one expression inside
the JVM. Where rules are ordered the first that holds decides. A null path gives null everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _or(parts: Sequence[str]) -> str:
    return "(" + " OR ".join(parts) + ")"


def within(*names: str, of: str = "parts") -> str:
    return _or([f"array_contains({of}, '{n}')" for n in names])


def named(*names: str, of: str = "name") -> str:
    return f"{of} IN (" + ", ".join(f"'{n}'" for n in names) + ")"


def begins(*heads: str, of: str = "name") -> str:
    return _or([f"left({of}, {len(h)}) = '{h}'" for h in heads])


def ends(*tails: str, of: str = "name") -> str:
    return _or([f"right({of}, {len(t)}) = '{t}'" for t in tails])


def holds(*texts: str, of: str = "whole") -> str:
    return _or([f"contains({of}, '{t}')" for t in texts])


# Folders, names and extensions of the rules.
BUILD_DIRS = (".tmp", "node_modules", ".svelte-kit", ".next", "dist", "build", "target", ".venv", "venv", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".cache", "coverage")
LOCK_NAMES = ("cargo.lock", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "poetry.lock", "pipfile.lock", "composer.lock")
TEST_EXTENSIONS = (".js", ".jsx", ".py", ".rs", ".svelte", ".ts", ".tsx")
TEST_FOLDERS, SCRIPT_FOLDERS = ("__tests__", "test", "tests"), ("scripts", "tools")
LAYER_OF_FOLDER = {"adapters": "adapter", "architecture": "architecture", "atlas": "atlas", "cli": "cli", "contracts": "contract", "core": "core", "frontends": "frontend", "retrieval": "retrieval", "service": "service"}
CODE_EXTENSIONS = (".py", ".rs", ".ts", ".js", ".go", ".java", ".c", ".cpp")
CONCEPTS = {"sha256": "hashing", "error": "error_policy", "bundle": "bundling", "merge": "merge_logic", "extract": "extraction", "policy": "policy"}
REPO_ROLES = {"tooling": ("tool", "merger"), "contracts": ("contract", "schema"), "governance": ("meta",), "education": ("lern",), "knowledge-base": ("geist",), "logic-core": ("haus",), "ingestion": ("sensor",), "ui": ("ui", "app", "leitstand"), "fleet-management": ("wgx",)}
TRUST = {"instruction": ("agents.md", "claude.md", "copilot-instructions.md"), "documentation": (".md", ".rst", ".txt", ".adoc")}

# Ordered: the reading lens of a path.
LENSES = (
    ("guards", _or([within(".github", "wgx", "guards", "tests", "test"), begins("test_", "validate_"), ends("_test.py", ".test.ts", ".spec.ts"), holds("validation")])),
    ("data_models", _or([within("contracts", "schemas", "models", "types"), ends(".schema.json", ".proto", ".thrift"), named("structs.rs", "types.ts", "models.py")])),
    ("pipelines", _or([within("pipelines", "jobs", "orchestration"), holds("workflow")])),
    ("entrypoints", _or([within("frontends", "cli", "bin"), named("__main__.py", "main.rs", "index.ts", "index.js", "manage.py"), begins("run_", "start_")])),
    ("ui", _or([within("ui", "app", "web", "frontend", "views", "templates"), ends(".html", ".svelte", ".css")])),
    ("interfaces", _or([within("adapters", "interfaces", "api", "ports", "routes"), f"({within('service')} AND NOT {within('core')})"])),
    ("core", _or([within("core", "logic", "domain"), named(*CODE_EXTENSIONS, of="ext")])),
    ("entrypoints", within("docs")),
    ("data_models", named(".json", ".yaml", ".yml", ".toml", of="ext")),
    ("core", "path IS NOT NULL"),
)
IS_TEST = _or([f"({named(*TEST_EXTENSIONS, of='ext')} AND {_or([begins('test_'), holds('.test.', '.spec.', '_test.', of='name')])})", within(*TEST_FOLDERS)])
PROJECTIONS = (("fixture", within("fixtures")), ("test", IS_TEST), ("script", within(*SCRIPT_FOLDERS)), ("product", "path IS NOT NULL"))
SEMANTIC_LAYERS = (("core", within("core")), ("test", within("tests", "test")), ("cli", within("cli")), ("docs", within("docs")), ("infra", within("scripts")), ("unknown", "path IS NOT NULL"))
ARTIFACT_TYPES = (("code", named(".py", of="ext")), ("data", named(".json", of="ext")), ("documentation", named(".md", ".txt", ".rst", of="ext")), ("script", named(".sh", ".bash", ".zsh", of="ext")), ("other", "path IS NOT NULL"))
# Any number: facets and roles.
FACETS = (
    ("contract", ends(".schema.json")),
    ("test", f"(NOT {within('fixtures')} AND {_or([f'({begins('test_')} AND {ends('.py')})', ends('_test.py', '.test.ts', '.spec.ts', '.test.js', '.spec.js')])})"),
    ("retrieval", within("retrieval")),
)
ROLES = (
    ("doc-essential", f"({holds('readme', of='name')} AND {named('.md', '.rst', '.txt', '.adoc', of='ext')})"),
    ("config", _or([holds("config"), ends(".yml", ".yaml", ".toml")])),
    ("entrypoint", begins("run_", "main", "index")),
    ("ai-context", holds("ai", "context")),
)
NOISE = _or([within(*BUILD_DIRS, of="dirs"), named(*LOCK_NAMES), ends(".lock"), holds("lock", of="name")])
PRIORITY = _or([named("readme.md"), ends(".ai-context.yml"), f"({begins('runbook')} AND {named('.md', of='ext')})"])
CRITICAL = _or([named("readme.md", ".ai-context.yml"), holds(".wgx/profile.yml"), f"({holds('.github/workflows/')} AND {holds('guard')})"])
TRUST_CLASSES = (
    ("instruction", _or([named(*TRUST["instruction"]), ends(".ai-context.yml")])), ("test_data", _or([within("fixtures"), IS_TEST])),
    ("documentation", _or([named(*TRUST["documentation"], of="ext"), within("docs")])), ("source", "path IS NOT NULL"),
)


def first_of(rules: Sequence[tuple[str, str]]) -> str:
    """The result of the first rule that holds."""
    return "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for r, c in rules) + " END"


def all_of(rules: Sequence[tuple[str, str]]) -> str:
    """The results of all rules that hold, in their order, joined by commas."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in rules) + ")"


def layer_rules() -> list[tuple[str, str]]:
    """Architecture layer: tests, benchmarks, then the first folder that names a layer, scripts, else unknown."""
    test = first_of(PROJECTIONS) + " IN ('test', 'fixture')"
    return [("test", f"({test})"), ("benchmark", _or([begins("benchmark_"), within("benchmarks")]))]


def path_columns(rows: DataFrame) -> DataFrame:
    parts = F.split(F.translate("path", "\\", "/"), "/")
    name = F.lower(F.element_at(parts, -1))
    return rows.withColumns({"parts": parts, "dirs": F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.lower(p)), "name": name, "whole": F.lower("path"), "ext": F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)})


def architecture_layer() -> Column:
    named_layer = F.create_map(*[F.lit(x) for kv in LAYER_OF_FOLDER.items() for x in kv])
    first = F.get(F.filter(F.transform("parts", lambda p: F.try_element_at(named_layer, p)), lambda x: x.isNotNull()), F.lit(0))
    early = F.expr(first_of(layer_rules()))
    return F.coalesce(early, first, F.when(F.expr(first_of(PROJECTIONS)) == "script", F.lit("infra")), F.lit("unknown"))


def classify(rows: DataFrame) -> DataFrame:
    """Every class of a path at once: lens, projection, layer, facets, roles, trust, noise, priority, critical."""
    return path_columns(rows).withColumns({
        "lens": F.expr(first_of(LENSES)), "projection": F.expr(first_of(PROJECTIONS)), "architecture_layer": architecture_layer(), "semantic_layer": F.expr(first_of(SEMANTIC_LAYERS)),
        "path_artifact_type": F.expr(first_of(ARTIFACT_TYPES)), "facets": F.expr(all_of(FACETS)), "roles": F.expr(all_of(ROLES)), "trust": F.expr(first_of(TRUST_CLASSES)),
        "noise": F.expr(NOISE), "priority": F.expr(PRIORITY), "critical": F.expr(CRITICAL),
    })


def inclusion(level: str, most_bytes: int, size: str = "size", category: str = "category") -> str:
    """How a file enters a report at a level: full, meta-only or omitted."""
    priority = f"CASE WHEN {PRIORITY} THEN 'full' ELSE 'meta-only' END"
    if level == "overview":
        return priority
    if level == "summary":
        return f"CASE WHEN {category} IN ('doc', 'config', 'contract') THEN 'full' ELSE {priority} END"
    if level == "dev":
        return f"CASE WHEN contains(name, 'lock') THEN CASE WHEN {size} > 20000 THEN 'meta-only' ELSE 'full' END WHEN {category} IN ('source', 'test', 'config', 'contract') THEN 'full' WHEN {category} = 'doc' THEN {priority} ELSE 'meta-only' END"
    return "'full'" if level == "max" else f"CASE WHEN {size} <= {most_bytes} THEN 'full' ELSE 'omitted' END"


def glob_pattern(globs: Sequence[str]) -> str:
    """One expression for exclude globs: ``**`` any folders, ``*`` within a name, ``?`` one character; a bare name stands for any depth."""
    special = set("\\.^$+{}[]()|")

    def one(g: str) -> str:
        out, i = "", 0
        while i < len(g):
            if g.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif g.startswith("**", i):
                out, i = out + ".*", i + 2
            else:
                out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(g[i], "\\" + g[i] if g[i] in special else g[i]), i + 1
        return out if "/" in g else "(?:.*/)?" + out + "(?:/.*)?"

    return "^(?:" + "|".join(map(one, globs)) + ")$"


def concepts(content: Column) -> Column:
    """Concept names of the keywords a text holds, in their order."""
    low = F.lower(F.coalesce(content, F.lit("")))
    return F.concat_ws(",", *[F.when(low.contains(k), v) for k, v in CONCEPTS.items()])
