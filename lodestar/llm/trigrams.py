"""Required trigrams of regular expressions and trigram postings over blocks of texts.

``required`` walks a parsed expression and keeps what every match must hold: runs of literal
characters give trigrams that must all be there, alternatives give a choice between such demands.
Case does not count: texts and literals are lower-cased (ASCII) before.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import product

import numpy as np

try:
    from re import _constants as _c
    from re import _parser as _p
except ImportError:  # before Python 3.11
    import sre_constants as _c
    import sre_parse as _p

MOST_STRINGS = 48
Query = tuple | str | None  # ("and" | "or", parts), a trigram, or None for no demand


def _all(parts: Iterable[Query]) -> Query:
    kept = tuple(dict.fromkeys(p for p in parts if p is not None))
    return None if not kept else kept[0] if len(kept) == 1 else ("and", kept)


def _any(parts: Iterable[Query]) -> Query:
    kept = tuple(dict.fromkeys(parts))
    return None if not kept or None in kept else kept[0] if len(kept) == 1 else ("or", kept)


def _demand(strings: set[str] | None) -> Query:
    """Every match holds one of the strings."""
    if not strings:
        return None
    return _any(_all(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _walk(items) -> tuple[set[str] | None, Query]:
    """(all strings the items can match, or None; what a match must hold)."""
    run: set[str] = {""}
    demands: list[Query] = []
    exact = True

    def flush() -> None:
        nonlocal run, exact
        demands.append(_demand(run))
        run, exact = {""}, False

    for op, arg in items:
        strings: set[str] | None = None
        query: Query = None
        if op is _c.LITERAL:
            strings = {chr(arg).lower()} if arg < 128 else None
        elif op is _c.IN:
            chars = [chr(a).lower() for o, a in arg if o is _c.LITERAL and a < 128]
            strings = set(chars) if len(chars) == len(arg) and len(set(chars)) <= 6 else None
        elif op is _c.SUBPATTERN:
            strings, query = _walk(arg[-1])
        elif op is _c.BRANCH:
            ways = [_walk(b) for b in arg[1]]
            if all(s is not None for s, _ in ways):
                strings = set().union(*(s for s, _ in ways))
            query = _any(q if q is not None else _demand(s) for s, q in ways)
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) or str(op) == "POSSESSIVE_REPEAT":
            low, high, sub = arg
            s, q = _walk(sub)
            if (low, high) == (0, 1) and s is not None:
                strings = s | {""}
            elif low == high == 1:
                strings, query = s, q
            elif s is not None and low == high and len(s) == 1:
                strings = {next(iter(s)) * low}
            elif low > 0:
                query = q if q is not None else _demand(s)
        elif op in (_c.AT, _c.ASSERT, _c.ASSERT_NOT):
            continue
        if strings is not None and len(strings) * len(run) <= MOST_STRINGS:
            run = {a + b for a, b in product(run, strings)}
        else:
            flush()
            demands.append(query if query is not None else _demand(strings))
            if strings is not None and len(strings) <= MOST_STRINGS:
                run = set(strings)
    if exact:
        return run, _all([*demands, _demand(run)])
    demands.append(_demand(run))
    return None, _all(demands)


def required(pattern: str) -> Query:
    """What every text that matches must hold; None if nothing."""
    return _walk(_p.parse(pattern))[1]


def trigrams(query: Query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams(q) for q in query[1]))


# The letters outside ASCII that an expression without case takes for i, s and k.
_ALIKE = str.maketrans({"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"})


class Postings:
    """For each known trigram the texts of a block that hold it, as a column of bits."""

    def __init__(self, known: Iterable[str]) -> None:
        self._column = {t: i for i, t in enumerate(sorted(known))}
        self._table = np.zeros(1 << 24, dtype=np.uint16)
        for t, i in self._column.items():
            a, b, c = t.encode("latin-1")
            self._table[a << 16 | b << 8 | c] = i + 1

    def build(self, texts: list[str | None]) -> np.ndarray:
        """bits[text, trigram]"""
        data = [(t if t.isascii() else t.translate(_ALIKE)).encode("utf-8", "replace").lower() for t in (t or "" for t in texts)]
        bits = np.zeros((len(texts), len(self._column) + 1), dtype=bool)
        flat = np.frombuffer(b"\0\0\0".join(data), dtype=np.uint8).astype(np.uint32)
        if len(flat) >= 3:
            found = self._table[flat[:-2] << 16 | flat[1:-1] << 8 | flat[2:]]
            at = np.flatnonzero(found)
            ends = np.cumsum([len(d) + 3 for d in data])
            bits[np.searchsorted(ends, at, side="right"), found[at]] = True
        return bits

    def candidates(self, bits: np.ndarray, query: Query) -> np.ndarray:
        """Intersection and union of postings as the query asks for."""
        if query is None:
            return np.ones(len(bits), dtype=bool)
        if isinstance(query, str):
            return bits[:, self._column[query] + 1]
        sides = [self.candidates(bits, q) for q in query[1]]
        return np.logical_and.reduce(sides) if query[0] == "and" else np.logical_or.reduce(sides)


def check(pattern: str, text: str) -> bool:
    """Whether the demands of a pattern hold in a text that it matches (for tests)."""
    q = required(pattern)
    p = Postings(trigrams(q))
    return not re.search(pattern, text) or bool(p.candidates(p.build([text]), q)[0])
