"""Python code as a graph: symbols, imports, calls by scope, and what they resolve to across files.

Every file is parsed once by the language's own parser, inside Arrow batches; whatever one file alone
can tell (scopes, shadowing, aliases, the class of ``self``) is decided there. What lies between files
(modules, re-exports, inherited methods) is decided by joins on (repo_id, path, name), a bounded number
of hops each, so no repository is ever gathered in one task.

Defined cases: files that do not parse, null contents and files of other languages give no rows; equal
rows count once; a module that several files answer to is ambiguous and leads to none of them; cycles
of re-exports or of base classes end after HOPS.
"""

from __future__ import annotations

import ast
import builtins
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

HOPS = 4
SOURCE_ROOTS = ("src", "lib", "python")
BUILTINS = frozenset(dir(builtins))
FACTS = "repo_id string, path string, kind string, scope string, name string, line int, end_line int, col int, how string, module string, target string, attr string"
_COLUMNS = [c.split()[0] for c in FACTS.split(", ")]


def module_of(path: str) -> str:
    parts = path.removesuffix(".py").split("/")
    return ".".join(parts[:-1] if parts[-1] == "__init__" else parts)


def _absolute(path: str, module: str | None, level: int) -> str | None:
    """Module an import names, with leading dots counted from the file's package; None beyond the top."""
    if not level:
        return module
    package = path.split("/")[:-1]
    if level - 1 > len(package):
        return None
    base = package[: len(package) - level + 1]
    return ".".join([*base, *([module] if module else [])])


class _File(ast.NodeVisitor):
    """Facts of one file."""

    def __init__(self, path: str, tree: ast.Module) -> None:
        self.path, self.rows = path, []
        self.scopes: list[tuple[str, str]] = []  # (qualified name, kind)
        self.symbols: dict[str, str] = {}
        self.imports: dict[str, tuple[str | None, str | None]] = {}
        self.bound: dict[str, set[str]] = {}
        self._declare(tree, "", "module")
        self.visit(tree)

    def _declare(self, node: ast.AST, scope: str, kind: str) -> None:
        names = self.bound.setdefault(scope, set())
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                q = f"{scope}.{n.name}" if scope else n.name
                self.symbols[q] = "class" if isinstance(n, ast.ClassDef) else "function"
                if not isinstance(n, ast.ClassDef):
                    a = n.args
                    self.bound.setdefault(q, set()).update(x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))])
                self._declare(n, q, self.symbols[q])
                continue
            if isinstance(n, ast.Import):
                for x in n.names:
                    self.imports[x.asname or x.name.split(".")[0]] = (x.name if x.asname else x.name.split(".")[0], None)
                    self._fact("import", scope, x.asname or x.name, n, how="import", module=x.name)
            elif isinstance(n, ast.ImportFrom):
                module = _absolute(self.path, n.module, n.level)
                for x in n.names:
                    self.imports[x.asname or x.name] = (module, x.name)
                    self._fact("import", scope, x.asname or x.name, n, how="relative" if n.level else "from", module=module, target=x.name)
            elif isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
                names.add(n.id)
            self._declare(n, scope, kind)

    def _fact(self, kind: str, scope: str, name: str, n: ast.AST, how: str | None = None, module: str | None = None, target: str | None = None, attr: str | None = None) -> None:
        self.rows.append((kind, scope, name, n.lineno, n.end_lineno, n.col_offset, how, module, target, attr))

    def _inside(self) -> str:
        return self.scopes[-1][0] if self.scopes else ""

    def _symbol(self, n) -> None:
        scope = self._inside()
        q = f"{scope}.{n.name}" if scope else n.name
        self._fact("symbol", scope, q, n, how=self.symbols.get(q))
        for d in n.decorator_list:
            self.visit(d)
        if isinstance(n, ast.ClassDef):
            for b in n.bases:
                if isinstance(b, ast.Name) and b.id in self.symbols:
                    self._fact("base", q, b.id, b, how="local", target=b.id)
                elif isinstance(b, ast.Name) and b.id in self.imports:
                    module, name = self.imports[b.id]
                    self._fact("base", q, b.id, b, how="import", module=module, target=name)
                elif isinstance(b, ast.Attribute) and isinstance(b.value, ast.Name) and b.value.id in self.imports:
                    module, name = self.imports[b.value.id]
                    self._fact("base", q, b.attr, b, how="import", module=".".join(filter(None, (module, name))), target=b.attr)
        self.scopes.append((q, "class" if isinstance(n, ast.ClassDef) else "function"))
        for x in n.body:
            self.visit(x)
        self.scopes.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = visit_ClassDef = _symbol

    def visit_If(self, n: ast.If) -> None:
        t = n.test
        if not self.scopes and isinstance(t, ast.Compare) and isinstance(t.left, ast.Name) and t.left.id == "__name__" and any(isinstance(c, ast.Constant) and c.value == "__main__" for c in t.comparators):
            self._fact("entry", "", "__main__", n, how="main_guard")
        self.generic_visit(n)

    def _resolve_name(self, name: str) -> tuple[str, str | None, str | None]:
        """(how, module, target) of a bare name at this place, innermost scope first; class bodies are not scopes of their methods."""
        for q, kind in reversed(self.scopes):
            if kind == "class":
                continue
            if f"{q}.{name}" in self.symbols:
                return "local", None, f"{q}.{name}"
            if name in self.bound.get(q, ()):
                return "dynamic", None, None
        if name in self.symbols:
            return "local", None, name
        if name in self.imports:
            return "import", *self.imports[name]
        if name in self.bound.get("", ()):
            return "dynamic", None, None
        return ("builtin" if name in BUILTINS else "unknown"), None, None

    def visit_Call(self, n: ast.Call) -> None:
        f, scope = n.func, self._inside()
        own = next((q for q, k in reversed(self.scopes) if k == "class"), None)
        if isinstance(f, ast.Name):
            how, module, target = self._resolve_name(f.id)
            self._fact("call", scope, f.id, n, how, module, target)
        elif isinstance(f, ast.Attribute):
            text, v = ast.unparse(f), f.value
            if isinstance(v, ast.Name) and v.id in ("self", "cls") and own:
                self._fact("call", scope, text, n, "method", None, own, f.attr)
            elif isinstance(v, ast.Call) and isinstance(v.func, ast.Name) and v.func.id == "super" and own:
                self._fact("call", scope, text, n, "super", None, own, f.attr)
            elif isinstance(v, ast.Name):
                how, module, target = self._resolve_name(v.id)
                if how == "local" and self.symbols.get(target) == "class":
                    self._fact("call", scope, text, n, "method", None, target, f.attr)
                elif how == "import":
                    self._fact("call", scope, text, n, "import_attr", module, target, f.attr)
                else:
                    self._fact("call", scope, text, n, "dynamic")
            elif isinstance(v, ast.Attribute) and ast.unparse(v).split(".")[0] in self.imports:
                head, *rest = ast.unparse(v).split(".")
                module, name = self.imports[head]
                self._fact("call", scope, text, n, "import_attr", ".".join(filter(None, (module, name, *rest))), None, f.attr)
            else:
                self._fact("call", scope, text, n, "dynamic")
        else:
            self._fact("call", scope, "(expression)", n, "dynamic")
        self.generic_visit(n)


def facts(files: DataFrame) -> DataFrame:
    """Symbols, imports, bases, calls and entry points of whole Python files (repo_id, path, content)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r, p, t in zip(b["repo_id"], b["path"], b["content"]):
                try:
                    rows += [(r, p, *x) for x in _File(p, ast.parse(t)).rows]
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return files.where("path like '%.py' and content is not null").select("repo_id", "path", "content").mapInPandas(parse, FACTS).distinct()


def modules(files: DataFrame) -> DataFrame:
    """(repo_id, module, target): the one file that a module name of a repository stands for; null if several do."""
    f = files.where("path like '%.py'").select("repo_id", "path").distinct()
    dotted = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), r"(^|/)__init__$", ""), "/", ".")
    head = F.regexp_extract(dotted, r"^([^.]+)\.(.+)$", 1)
    names = F.array_compact(F.array(dotted, F.when(head.isin(*SOURCE_ROOTS), F.regexp_extract(dotted, r"^([^.]+)\.(.+)$", 2))))
    x = f.select("repo_id", "path", F.explode(F.array_distinct(names)).alias("module")).where("module <> ''")
    return x.groupBy("repo_id", "module").agg(F.when(F.count("*") == 1, F.min("path")).alias("target"), F.count("*").alias("n_files"))


def import_edges(fact: DataFrame, files: DataFrame) -> DataFrame:
    """Import edges with what they resolve to: local (a module, or a name of one), ambiguous, external."""
    m = modules(files)
    i = fact.where("kind = 'import'").select("repo_id", "path", "line", F.col("name").alias("alias"), "how", "module", F.col("target").alias("imported"))
    whole = m.select("repo_id", F.col("module"), F.col("target").alias("m_path"), F.col("n_files").alias("m_n"))
    part = m.select("repo_id", F.col("module").alias("sub"), F.col("target").alias("s_path"))
    x = i.withColumn("sub", F.concat_ws(".", "module", "imported")).join(whole, ["repo_id", "module"], "left").join(part, ["repo_id", "sub"], "left")
    state = F.when(F.col("imported").isNotNull() & F.col("s_path").isNotNull(), "local_module").when(F.col("m_path").isNotNull(), "local").when(F.col("m_n") > 1, "ambiguous").otherwise("external")
    path = F.when(state == "local_module", F.col("s_path")).when(state == "local", F.col("m_path"))
    symbol = F.when((state == "local") & F.col("imported").isNotNull(), F.col("imported"))
    return x.select("repo_id", "path", "line", "alias", "how", "module", "imported", state.alias("resolution"), path.alias("target_path"), symbol.alias("target_symbol"))


def _follow(rows: DataFrame, symbols: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, d_path, d_symbol) of each (key, repo_id, t_path, t_symbol): the file that defines the symbol, through re-exports."""
    defined = symbols.select("repo_id", F.col("path").alias("t_path"), F.col("name").alias("t_symbol"), F.lit(True).alias("here"))
    again = edges.where("target_symbol is not null").select("repo_id", F.col("path").alias("t_path"), F.col("alias").alias("t_symbol"), F.col("target_path").alias("n_path"), F.col("target_symbol").alias("n_symbol"))
    again = again.groupBy("repo_id", "t_path", "t_symbol").agg(F.max(F.struct("n_path", "n_symbol")).alias("n"))
    done, left = None, rows
    for _ in range(HOPS):
        x = stored(left.join(defined, ["repo_id", "t_path", "t_symbol"], "left"))
        hit = x.where("here").select(key, F.col("t_path").alias("d_path"), F.col("t_symbol").alias("d_symbol"))
        done = hit if done is None else done.unionByName(hit)
        left = x.where("here is null").drop("here").join(again, ["repo_id", "t_path", "t_symbol"]).select(key, "repo_id", F.col("n.n_path").alias("t_path"), F.col("n.n_symbol").alias("t_symbol"))
    return done


def resolve_calls(fact: DataFrame, files: DataFrame) -> DataFrame:
    """Every call with caller, status (resolved, external, builtin, dynamic, unresolved), reason, and the symbol called."""
    fact = stored(fact)
    edges = stored(import_edges(fact, files))
    symbols = fact.where("kind = 'symbol'").select("repo_id", "path", "name").distinct()
    calls = fact.where("kind = 'call'").withColumn("call_id", F.md5(F.concat_ws("\x1f", F.coalesce("repo_id", F.lit("")), "path", F.col("line").cast("string"), F.col("col").cast("string"), F.col("end_line").cast("string"), "name")))
    calls = stored(calls.groupBy("call_id").agg(*[F.first(c, ignorenulls=False).alias(c) for c in _COLUMNS if c not in ("kind",)]))
    mods = modules(files)
    # bare names and attributes of imported modules
    wanted = F.when(F.col("how") == "import", F.col("module")).otherwise(F.concat_ws(".", "module", "target"))
    imported = calls.where("how in ('import', 'import_attr')").withColumn("wanted", wanted)
    a = imported.join(mods.select("repo_id", F.col("module").alias("wanted"), F.col("target").alias("m_path"), F.col("n_files").alias("m_n")), ["repo_id", "wanted"], "left")
    local = a.where("m_path is not null").select("call_id", "repo_id", F.col("m_path").alias("t_path"), F.coalesce("attr", "target").alias("t_symbol")).where("t_symbol is not null")
    # an imported class or name with an attribute: the name lives in the module before it
    of_name = imported.where("how = 'import_attr' and target is not null").join(mods.select("repo_id", "module", F.col("target").alias("m_path")), ["repo_id", "module"]).where("m_path is not null")
    of_name = of_name.select("call_id", "repo_id", F.col("m_path").alias("t_path"), F.concat_ws(".", "target", "attr").alias("t_symbol"))
    found = _follow(local.unionByName(of_name), symbols, edges, "call_id")
    found = found.unionByName(calls.where("how = 'local'").select("call_id", F.col("path").alias("d_path"), F.col("target").alias("d_symbol")))
    # methods, along single base classes
    bases = fact.where("kind = 'base'")
    near = bases.where("how = 'local'").select("repo_id", "path", F.col("scope").alias("cls"), F.col("path").alias("b_path"), F.col("target").alias("b_cls"))
    far = bases.where("how = 'import' and target is not null").join(mods.select("repo_id", "module", F.col("target").alias("b_path")), ["repo_id", "module"]).where("b_path is not null").select("repo_id", "path", F.col("scope").alias("cls"), "b_path", F.col("target").alias("b_cls"))
    up = near.unionByName(far).groupBy("repo_id", "path", "cls").agg(F.count("*").alias("n_bases"), F.min("b_path").alias("b_path"), F.min("b_cls").alias("b_cls")).where("n_bases = 1").drop("n_bases")
    up = stored(up)
    m = calls.where("how in ('method', 'super')").select("call_id", "repo_id", "path", F.col("target").alias("cls"), "attr", (F.col("how") == "super").alias("skip"))
    methods = symbols.select("repo_id", "path", F.col("name").alias("method"), F.lit(True).alias("here"))
    for _ in range(HOPS):
        x = stored(m.withColumn("method", F.concat_ws(".", "cls", "attr")).join(methods, ["repo_id", "path", "method"], "left"))
        found = found.unionByName(x.where("here and not skip").select("call_id", F.col("path").alias("d_path"), F.col("method").alias("d_symbol")))
        m = x.where("here is null or skip").join(up, ["repo_id", "path", "cls"]).select("call_id", "repo_id", F.col("b_path").alias("path"), F.col("b_cls").alias("cls"), "attr", F.lit(False).alias("skip"))
    one = found.groupBy("call_id").agg(F.count_distinct("d_path", "d_symbol").alias("n"), F.min(F.struct("d_path", "d_symbol")).alias("d"))
    known = a.groupBy("call_id").agg(F.max("m_n").alias("m_n"))
    x = calls.join(one, "call_id", "left").join(known, "call_id", "left")
    status = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").when(F.col("how") == "builtin", "builtin").when(F.col("how") == "dynamic", "dynamic").when(F.col("how").isin("import", "import_attr") & F.col("m_n").isNull(), "external").otherwise("unresolved")
    reason = F.when(status.isin("resolved", "builtin"), F.lit(None)).when(F.col("n") > 1, "several_definitions").when(F.col("m_n") > 1, "ambiguous_module").when(F.col("how") == "dynamic", "dynamic_receiver").when(status == "external", "module_not_in_repository").when(F.col("how").isin("method", "super"), "no_such_method").when(F.col("how") == "unknown", "unknown_name").otherwise("no_such_symbol")
    return x.select("call_id", "repo_id", "path", F.col("scope").alias("caller"), "name", "line", "col", "how", status.alias("status"), reason.alias("reason"), F.when(F.col("n") == 1, F.col("d.d_path")).alias("target_path"), F.when(F.col("n") == 1, F.col("d.d_symbol")).alias("target_symbol"))


def unresolved_causes(calls: DataFrame) -> DataFrame:
    """Calls per status and reason with their share."""
    total = calls.agg(F.count("*").alias("n")).select("n")
    return calls.groupBy("status", "reason").agg(F.count("*").alias("n_calls")).withColumn("share", F.round(F.col("n_calls") / total.scalar(), 6))


def caller_groups(calls: DataFrame, fact: DataFrame) -> DataFrame:
    """Per called symbol and calling symbol: call sites in order and the caller's lines; callers outside of functions stand for their file."""
    span = fact.where("kind = 'symbol'").groupBy("repo_id", "path", F.col("name").alias("caller")).agg(F.min("line").alias("caller_start"), F.max("end_line").alias("caller_end"))
    g = calls.where("status = 'resolved'").groupBy("repo_id", "target_path", "target_symbol", "path", "caller").agg(F.count("*").alias("n_sites"), F.array_sort(F.collect_set("line")).alias("lines"))
    return g.join(span, ["repo_id", "path", "caller"], "left")


def callee_groups(calls: DataFrame) -> DataFrame:
    """Per calling symbol and called symbol: kinds of relation, sorted, and sites."""
    return calls.where("status = 'resolved'").groupBy("repo_id", "path", "caller", "target_path", "target_symbol").agg(F.array_join(F.array_sort(F.collect_set("how")), ",").alias("relations"), F.count("*").alias("n_sites"))


def relation_cards(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, source, target, relation, n): relations of two files of a repository, by calls and by imports."""
    c = calls.where("status = 'resolved' and target_path <> path").groupBy("repo_id", F.col("path").alias("source"), F.col("target_path").alias("target")).agg(F.count("*").alias("n")).withColumn("relation", F.lit("calls"))
    i = edges.where("target_path is not null and target_path <> path").groupBy("repo_id", F.col("path").alias("source"), F.col("target_path").alias("target")).agg(F.count("*").alias("n")).withColumn("relation", F.lit("imports"))
    return c.unionByName(i)


def impact(cards: DataFrame, changed: DataFrame, is_test: Column, entries: DataFrame) -> DataFrame:
    """What one step around changed files touches: relation and direction, whether a test or an entry point stands there."""
    t = changed.select("repo_id", F.col("path").alias("changed")).distinct()
    out = cards.join(t, (cards["repo_id"] == t["repo_id"]) & (cards["source"] == t["changed"])).select(cards["repo_id"], "changed", F.col("target").alias("path"), "relation", F.lit("depends_on").alias("direction"), "n")
    into = cards.join(t, (cards["repo_id"] == t["repo_id"]) & (cards["target"] == t["changed"])).select(cards["repo_id"], "changed", F.col("source").alias("path"), "relation", F.lit("used_by").alias("direction"), "n")
    g = out.unionByName(into).groupBy("repo_id", "changed", "path").agg(F.array_join(F.array_sort(F.collect_set("relation")), ",").alias("relations"), F.array_join(F.array_sort(F.collect_set("direction")), ",").alias("directions"), F.sum("n").alias("n_sites"))
    e = entries.select("repo_id", "path").distinct().withColumn("entry", F.lit(True))
    return g.join(e, ["repo_id", "path"], "left").withColumns({"is_entry": F.coalesce("entry", F.lit(False)), "is_test": is_test}).drop("entry")


def related_tests(impacted: DataFrame, k: int) -> DataFrame:
    """Tests for each changed file: one per kind of evidence first, then the rest by sites."""
    from pyspark.sql import Window

    t = impacted.where("is_test")
    first = F.row_number().over(Window.partitionBy("repo_id", "changed", "relations").orderBy(F.desc("n_sites"), "path"))
    t = t.withColumn("phase", F.when(first == 1, 0).otherwise(1))
    rank = F.row_number().over(Window.partitionBy("repo_id", "changed").orderBy("phase", F.desc("n_sites"), "path"))
    return t.withColumn("rank", rank).where(F.col("rank") <= k).select("repo_id", "changed", "rank", "path", "relations", "n_sites")
