"""Literal credentials in code, configuration and notes: where they stand, and texts without them.

Detection expressions are verified on candidates only: each block of chunks gets trigram postings
for the trigrams that the expressions demand, and an expression runs on the chunks that the
intersection of its postings leaves. What a name assigns is a case only if its value looks like a
secret: placeholders, references to variables or vaults, words of a sentence, digests, identifiers
and public keys are none.

Defined cases: null and empty contents give no rows; a value over several lines counts on the line
where it starts; repeated chunks give each place once; contents and values of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .trigrams import Postings, required, trigrams

MASK, LONG = "REDACTED", 400
_B, _E = r"(?<![A-Za-z0-9+/_-])", r"(?![A-Za-z0-9+/_-])"
_NAME = (
    r"(?:pass(?:word|wd|phrase|code)?|pwd|[_-]pw|[ \t\n\"'`]pw|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key|signing[_-]?key|encryption[_-]?key|"
    r"account[_-]?key|master[_-]?key|auth[_-]?key|credentials?|bearer|kennwort|passwort)"
)
# name, end of name, quotes around it, how it is assigned, opening quote, value
_GIVEN = (
    r"(?P<name>" + _NAME + r"(?:[_-][a-z0-9]{2,4}|s|value|str)?)(?P<q>[\"'`]?)"
    r"(?P<op>\s*(?::\s*&?(?:'static\s+)?(?:str|String|string)\s*=|:=|=>|->|==?|:(?!:)|,)\s*\(?\s*|\s+(?:is|lautet|ist)\s+:?\s*|[ ]+(?=[\"']))"
)
_VALUE = r"(?P<o>b?[\"'`])(?P<quoted>(?:\\.|(?!(?P=o))[^\n\\]){5,})(?P=o)|(?P<open>[^\s\"'`,;(){}\[\]<>]{6,})"
EXPRESSIONS = {
    "cloud key": _B + r"(?P<v>A(?:KIA|SIA|ROA|IDA)[0-9A-Z]{16})" + _E,
    "forge token": _B + r"(?P<v>gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_-]{20,}|npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_-]{50,})" + _E,
    "chat token": _B + r"(?P<v>xox[abeoprs]-[0-9A-Za-z-]{10,})" + _E,
    "payment key": _B + r"(?P<v>[rsp]k_(?:live|test)_[0-9A-Za-z]{16,})" + _E,
    "service key": _B + r"(?P<v>AIza[0-9A-Za-z_-]{35}|sk-[A-Za-z0-9_-]{20,}|SG\.[\w-]{16,}\.[\w-]{16,})" + _E,
    "signed token": _B + r"(?P<v>eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{10,})",
    "private key": r"(?P<v>-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----(?:[^-]|-(?!----))*(?:-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----)?)",
    "address": r"(?<=[A-Za-z0-9])://[^\s/:@\"'`<>{}$]*:(?P<v>[^\s/@\"'`]{3,})@[A-Za-z0-9\[]",
    "basic header": r"\b[Bb]asic[ ]+(?P<v>[A-Za-z0-9+/_-]{8,}={0,2})",
    "bearer header": r"\b[Bb]earer[ ]+(?P<v>[A-Za-z0-9._~+/-]{16,}=*)",
    "given name": r"(?i)" + _GIVEN + r"(?:" + _VALUE + r")",
}
COMPILED = {k: re.compile(p) for k, p in EXPRESSIONS.items()}
DEMANDS = {k: required(p) for k, p in EXPRESSIONS.items()}
KNOWN = set().union(*(trigrams(q) for q in DEMANDS.values()))

_PLACEHOLDER = re.compile(
    r"(?i)^(?:<.*>|\[.*\]|\{.*\}|\$.*|%[({a-z].*|x{3,}.*|\*{3,}.*|\.{3,}.*|_+|-+|(?:your|my|the|insert|enter|replace|change|put|dummy|sample|example|todo|fixme|tbd|none|null|nil|"
    r"undefined|true|false|changeme|placeholder|redacted|masked|hidden|removed|secret|password|passwd|passwort|token|default|test|foo|bar|admin|string|str|bytes|int|bool|any|optional)\b.*)$"
)
_REFERENCE = re.compile(
    r"(?i)(?:\$\{|\$\(|\{\{|%\(|\benv\b|environ|getenv|process\.|vault|secretsmanager|keyring|\bssm:|\bref\+|^@|^\$|^&|^\*[a-z]|^[a-z_][\w.]*\(|^file:|^arn:|^/[\w/.-]+$|^(?:self|this|config|settings|args|os|request|cfg)\.)"
)
_OTHER_END = re.compile(r"(?i)[_-](?:len|ttl|id|url|uri|env|ref|max|min|file|path|name|type|hash|hint|sha|md5|num|size|key_id|age|mode|kind|rule|test)$")
_IDENTIFIER = re.compile(r"^(?:[a-z]+(?:_[a-z]+)*|[A-Z]+(?:_[A-Z0-9]+)*|[A-Za-z][a-z]*(?:[A-Z][a-z]+)*|[a-z]+(?:[.:/-][a-z]+)*|[A-Za-z_][\w]*(?:\.[A-Za-z_]\w*)+)$")
_HEX = re.compile(r"^[0-9a-fA-F]+$")
_UUID = re.compile(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")


def looks_secret(value: str) -> bool:
    """Whether the value itself, whatever its name, can be a secret."""
    v = value.strip()
    if len(v) < 6 or _PLACEHOLDER.match(v) or _REFERENCE.search(v) or any(c.isspace() for c in v):
        return False
    if _UUID.match(v) or v.isdigit() or _IDENTIFIER.match(v):
        return False
    digits, letters = sum(c.isdigit() for c in v), sum(c.isalpha() for c in v)
    signs = len(v) - digits - letters
    if not letters or re.match(r"^[\d.,:+-]+[a-zA-Z%]{0,3}$", v):
        return False
    mixed = (digits > 0) + (signs > 0) + any(c.isupper() for c in v) * any(c.islower() for c in v)
    return mixed >= 2 or digits >= 2 and len(v) >= 8 or len(v) >= 16 and mixed >= 1


def _given(m: re.Match, text: str) -> tuple[int, int] | None:
    op, first = m.group("op"), m.start()
    while first and (text[first - 1].isalnum() or text[first - 1] in "_.-"):
        first -= 1
    name = text[first : m.end("name")]
    if text[max(0, first - 2) : first] == "::" or re.search(r"(?i)\bvalues\s*\(", text[text.rfind("\n", 0, first) + 1 : first]):
        return None
    if _OTHER_END.search(name):
        return None
    kind = "quoted" if m.group("quoted") is not None else "open"
    value, at = m.group(kind), m.start(kind)
    if kind == "open":
        if "\n" in op or op.strip() in ("(", ",") or (op.strip() == "" and "is" not in op):
            return None
        value = value.rstrip(".:!?|\\")
        line = text[text.rfind("\n", 0, m.start()) + 1 : m.end()].lstrip()
        rest = text[m.end() : m.end() + 1]
        if rest == "(" or "{" in text[m.end() : m.end() + 1] or value.startswith(("-", "http")):
            return None
        # bare words are values in comments, notes, shell and settings, not in code
        if re.match(r"^[A-Za-z_][\w.]*$", value) and not re.search(r"\d", value) and not line.startswith(("#", "//", "--", "*")):
            return None
    if op.strip() == "," and not m.group("q"):
        return None
    return (at, at + len(value)) if looks_secret(value) else None


def _given_values(expression: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """Values that names assign; in a LONG one that is no secret the search goes on, as it may hold others."""
    at = 0
    while m := expression.search(text, at):
        at = m.end()
        if (s := _given(m, text)) is not None:
            yield s
        elif at - m.end("op") > LONG:
            at = m.end("op")


def find(text: str, which: set[str] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret value, without overlaps, in order."""
    spans: list[tuple[int, int, str]] = []
    for kind, expression in COMPILED.items():
        if which is not None and kind not in which:
            continue
        if kind == "given name":
            spans += [(*s, kind) for s in _given_values(expression, text)]
            continue
        for m in expression.finditer(text):
            v = m.group("v")
            if kind == "private key":
                body = re.sub(r"-----[^-]*-----", "", v)
                if not re.search(r"[A-Za-z0-9+/=]{24}", body) and m.end() < len(text.rstrip()):
                    continue
            elif kind == "address" and (_PLACEHOLDER.match(v) or _REFERENCE.search(v) or re.fullmatch(r"(?i)\*+|x+|pass(?:word|wd)?|secret|pw|pwd|\d{1,5}", v)):
                continue
            elif kind == "basic header" and (not re.search(r"[A-Z0-9+/=]", v) or v.isalpha() and len(v) < 12):
                continue
            elif kind == "bearer header" and not looks_secret(v):
                continue
            elif _PLACEHOLDER.match(v):
                continue
            spans.append((m.start("v"), m.end("v"), kind))
    spans.sort(key=lambda s: (s[0], -s[1]))
    out: list[tuple[int, int, str]] = []
    for s in spans:
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def scan(texts: list[str | None], postings: Postings) -> Iterator[tuple[int, list[tuple[int, int, str]]]]:
    """(index, secrets) of the texts of a block that hold any."""
    bits = postings.build(texts)
    hits = {k: postings.candidates(bits, q) for k, q in DEMANDS.items()}
    for i, t in enumerate(texts):
        which = {k for k, h in hits.items() if h[i]}
        if t and which and (found := find(t, which)):
            yield i, found


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with only the values replaced; line ends inside a value stay."""
    out, last = [], 0
    for a, b, _ in spans:
        out += [text[last:a], MASK + "\n" * text.count("\n", a, b)]
        last = b
    return "".join([*out, text[last:]])


def secrets(chunks: DataFrame) -> DataFrame:
    """(chunk_id, line_no, kind) of every literal secret."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        postings = Postings(KNOWN)
        for b in batches:
            texts, ids, rows = b["content"].tolist(), b["chunk_id"].tolist(), []
            for i, found in scan(texts, postings):
                rows += [(ids[i], texts[i].count("\n", 0, a) + 1, k) for a, _, k in found]
            yield pd.DataFrame(rows, columns=["chunk_id", "line_no", "kind"])

    return chunks.select("chunk_id", "content").mapInPandas(places, "chunk_id string, line_no long, kind string").distinct()


def redacted(chunks: DataFrame) -> DataFrame:
    """(chunk_id, content, n_secrets) of the chunks that hold secrets, with the values replaced."""

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        postings = Postings(KNOWN)
        for b in batches:
            texts, ids = b["content"].tolist(), b["chunk_id"].tolist()
            rows = [(ids[i], redact(texts[i], found), len(found)) for i, found in scan(texts, postings)]
            yield pd.DataFrame(rows, columns=["chunk_id", "content", "n_secrets"])

    return chunks.select("chunk_id", "content").mapInPandas(clean, "chunk_id string, content string, n_secrets int").distinct()
