"""Generated, minified and vendored source files and data blobs.

For each file a Re-Pair grammar is inferred over its token classes and its size is set against the
number of tokens (``grammar_share``): a file written by a tool reuses a few rules all over. A
heading that names a tool, or a file name that tools give, lowers the reuse asked for. Literals
that fill most of a file and that the grammar of their characters hardly shortens make a data
blob; dense lines of short names make a minified file. Vendoring: the rules that a file marked as a
copy (path or heading) shares with files of other repositories carry the mark on. Rules are those of
a second Re-Pair grammar over the token texts, compared as expanded, and the pairs of neighbouring
lines, which also stand for text that nothing repeats; either must be shared to COPIED_SHARE. The mark
tells the copy from the original: without one, equal files in two repositories are not vendored.

Defined cases: files with a null content in any chunk are none; empty files are none; texts of any
length are read whole; repeated rows count once; ties cannot arise, as every file is judged by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import source_files
from .repair import grammar_rules, grammar_sizes

TOKENS = re.compile(
    r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`[^`]*`|[A-Za-z_$][\w$]*|\d[\w.]*|\n[ \t]*|[^\s\w]'
)
KEYWORDS = frozenset(
    "if else for while return def class func fn let const var import from export switch case match with try except catch "
    "throw raise new async await pub struct type in not and or is this self package use impl do done then fi esac defer "
    "range go assert lambda yield static function".split()
)
GENERATED_SHARE, MARKED_SHARE, LEAST_TOKENS = 0.25, 0.65, 90
BLOB_SHARE, BLOB_LITERAL, BLOB_CHARS, BLOB_GRAMMAR = 0.5, 32, 200, 0.55
MINIFIED_BLANKS, MINIFIED_LINE, MINIFIED_NAME = 0.08, 100, 5.5
COPIED_SHARE, LEAST_PAIRS, RULE_TOKENS = 0.6, 3, 12
BATCH_TOKENS = 400_000

_COMMENT = r"^\s*(?:#|//|--|/?\*+|<!--|;|\"\"\")"
MADE = re.compile(
    _COMMENT + r".{0,160}?(?:@generated\b|\bcode generated\b|<?\bauto-?generated\b|\bgenerated (?:by|from|with)\b|\bmachine-(?:written|generated)\b|"
    r"\b(?:do not|don't) (?:edit|modify)\b|\bautomatisch (?:erzeugt|generiert)|\boutput of `[^`]+`)", re.I | re.M
)
COPIED = re.compile(
    _COMMENT + r"\s*(?:@?vendored (?:from|copy)|third[- ]party (?:code|copy)|upstream:\s*\S.{0,200}?\b(?:imported|version|v?\d+\.\d)|"
    r"(?:copied|imported|taken) (?:unchanged |verbatim |unmodified |as is )?from (?:the )?upstream\b)", re.I | re.M
)
MADE_NAME = re.compile(
    r"(?:_pb2?(?:_grpc)?\.(?:py|js|ts)|\.pb\.(?:go|cc|h)|[._](?:generated|gen|g)\.\w+|(?:^|/)(?:package-lock\.json|yarn\.lock|"
    r"pnpm-lock\.yaml|poetry\.lock|cargo\.lock|go\.sum|composer\.lock))$", re.I
)
LOCKS = re.compile(r"(?:^|/)(?:package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|cargo\.lock|go\.sum|composer\.lock)$", re.I)
COPIED_PATH = re.compile(r"(?:^|/)(?:_?vendor(?:ed)?|third[_-]?party|node_modules|external|externals|deps|bower_components|pods)/", re.I)
SCRIPT = re.compile(r"\.(?:[cm]?js|jsx|ts|tsx|css)$", re.I)
PROSE = re.compile(r"\.(?:md|rst|txt|adoc|pem|key|crt|pub)$", re.I)


class _Classes(dict):
    """Class number of a token text: keywords and signs stand for themselves."""

    def __missing__(self, token: str) -> int:
        c = token[0]
        if c == "\n":
            name = "\n"
        elif c in "\"'`":
            name = '"'
        elif c.isdigit():
            name = "0"
        elif (c.isalpha() or c in "_$") and token not in KEYWORDS:
            name = "a"
        else:
            name = token
        number = self._names.setdefault(name, len(self._names))
        if len(self) < 500_000:
            self[token] = number
        return number

    _names: dict[str, int] = {}


class _Hashes(dict):
    """Stable 64-bit hash of a token text."""

    def __missing__(self, token: str) -> int:
        import xxhash

        v = xxhash.xxh64_intdigest(token)
        if len(self) < 500_000:
            self[token] = v
        return v


def _figures(paths: list[str], contents: list[str], classes: _Classes, hashes: _Hashes) -> Iterator[dict]:
    """Figures and kind of each file of one batch."""
    look = classes.__getitem__
    tokens = [TOKENS.findall(t) for t in contents]
    flat = np.fromiter((look(x) for ts in tokens for x in ts), dtype=np.int64)
    lengths = [len(ts) for ts in tokens]
    start, rules = grammar_sizes(flat, lengths)
    code = [[x for x in ts if x[0] != "\n"] for ts in tokens]
    named = hashes.__getitem__
    of, keys, covered = grammar_rules(np.fromiter((named(x) for ts in code for x in ts), dtype=np.uint64), [len(ts) for ts in code], RULE_TOKENS)
    ends = np.searchsorted(of, np.arange(len(code) + 1))
    rows, literals = [], []
    for p, t, ts in zip(paths, contents, tokens):
        bare = sum(map(len, t.split()))
        lit = "".join(x for x in ts if (x[0].isdigit() or len(x) >= BLOB_LITERAL and x[0] in "\"'`" and " " not in x and "\n" not in x))
        names = [x for x in ts if x[0].isalpha() or x[0] in "_$"]
        full = bare and len(lit) >= BLOB_CHARS and len(lit) >= BLOB_SHARE * bare * (0.8 if lit[0].isdigit() else 1)
        rows.append((bare, sum(map(len, names)) / max(1, len(names)), bool(full)))
        literals.append(np.frombuffer(lit.encode("utf-8", "replace"), dtype=np.uint8) if full else np.zeros(0, dtype=np.uint8))
    l_start, l_rules = grammar_sizes(np.concatenate(literals).astype(np.int64) if literals else np.zeros(0), [len(x) for x in literals])
    for i, (p, t) in enumerate(zip(paths, contents)):
        bare, name, full = rows[i]
        n = lengths[i]
        share = (int(start[i]) + 2 * int(rules[i])) / n if n else 1.0
        dense = (int(l_start[i]) + 2 * int(l_rules[i])) / len(literals[i]) if full else 0.0
        prose = bool(PROSE.search(p))
        named = bool(MADE_NAME.search(p))
        made = bool(MADE.search(t)) and not prose
        lines = t.count("\n") + 1
        blanks = 1 - bare / len(t) if t else 1.0
        kind = None
        if prose or not bare:
            pass
        elif (made or named) and (share <= MARKED_SHARE or LOCKS.search(p)):
            kind = "generated"
        elif full and dense >= BLOB_GRAMMAR:
            kind = "blob"
        elif SCRIPT.search(p) and blanks <= MINIFIED_BLANKS and len(t) / lines >= MINIFIED_LINE and name <= MINIFIED_NAME:
            kind = "minified"
        elif n >= LEAST_TOKENS and share <= GENERATED_SHARE:
            kind = "generated"
        marked = not prose and bool(COPIED_PATH.search(p.replace("\\", "/")) or COPIED.search(t))
        text = [x.strip() for x in t.split("\n")]
        text = [x for x in text if len(x) > 3]
        pairs = {hash_pair(a, b) for a, b in zip(text, text[1:])}
        yield {"kind": kind, "marked": marked, "n_tokens": n, "grammar_share": share, "literal_share": len(literals[i]) / max(1, bare), "line_rules": list(pairs), "n_code": len(code[i]), "rules": (keys[ends[i] : ends[i + 1]] >> np.uint64(1)).astype(np.int64), "rule_tokens": covered[ends[i] : ends[i + 1]].astype(np.int32)}


def hash_pair(a: str, b: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(a + "\n" + b) >> 1


FIGURES = "repo_id string, path string, kind string, marked boolean, n_tokens int, grammar_share double, literal_share double, line_rules array<long>, n_code int, rules array<long>, rule_tokens array<int>"


def file_figures(chunks: DataFrame) -> DataFrame:
    """Grammar figures of every file that is whole."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes, hashes = _Classes(), _Hashes()
        for b in batches:
            size = b["content"].str.len().cumsum() // (BATCH_TOKENS * 4)
            for _, part in b.groupby(size):
                rows = pd.DataFrame(list(_figures(part["path"].tolist(), part["content"].tolist(), classes, hashes)))
                rows.insert(0, "path", part["path"].to_numpy())
                rows.insert(0, "repo_id", part["repo_id"].to_numpy())
                yield rows

    return source_files(chunks).mapInPandas(judge, FIGURES)


def _carried(figures: DataFrame, rules: Column, whole: Column, least: int) -> DataFrame:
    """(repo_id, path) of the files that consist to COPIED_SHARE of rules of marked files of other repositories."""
    rows = figures.select("repo_id", "path", "marked", "kind", whole.alias("n"), F.explode(rules).alias("r")).select("*", "r.rule", "r.weight").drop("r")
    # a rule that is in marked files of two repositories stands for either
    own = rows.where("marked").groupBy("rule").agg(F.min("repo_id").alias("a_repo"), F.max("repo_id").alias("b_repo"))
    rest = rows.where("not marked and kind is null").where(F.col("n") >= least)
    met = rest.join(own, "rule").where((F.col("a_repo") != F.col("repo_id")) | (F.col("b_repo") != F.col("repo_id")))
    shared = met.groupBy("repo_id", "path", "n").agg(F.sum("weight").alias("shared"))
    return shared.where(F.col("shared") >= COPIED_SHARE * F.col("n")).select("repo_id", "path")


def file_origins(chunks: DataFrame) -> DataFrame:
    """(repo_id, path, origin, grammar_share, ...) of the files that are not hand-written."""
    from ..session import stored

    figures = stored(file_figures(chunks))
    lines = F.transform("line_rules", lambda r: F.struct(r.alias("rule"), F.lit(1).alias("weight")))
    grammar = F.transform(F.arrays_zip("rules", "rule_tokens"), lambda r: F.struct(r["rules"].alias("rule"), r["rule_tokens"].alias("weight")))
    copied = _carried(figures, lines, F.size("line_rules"), LEAST_PAIRS).union(_carried(figures, grammar, F.col("n_code"), LEAST_TOKENS))
    copied = copied.distinct().withColumn("shared", F.lit(True))
    same = (F.col("f.path") == F.col("c.path")) & F.col("f.repo_id").eqNullSafe(F.col("c.repo_id"))
    judged = figures.alias("f").join(copied.alias("c"), same, "left").select("f.*", "c.shared")
    origin = F.when(F.col("marked"), "vendored").otherwise(F.coalesce("kind", F.when(F.col("shared").isNotNull(), F.lit("vendored"))))
    return judged.withColumn("origin", origin).where("origin is not null").select("repo_id", "path", "origin", "n_tokens", "grammar_share", "literal_share")
