"""Re-Pair grammars of many sequences at once.

Re-Pair replaces the most frequent pair of neighbouring symbols by a new rule until no pair
occurs twice. Here all sequences of a batch are reduced together, and in one round a sequence
replaces every pair that is more than half as frequent as its most frequent one; where pairs
overlap the more frequent one wins and runs are cut from the left. Rules belong to one sequence;
``grammar_rules`` names them by what they stand for, so that rules of different sequences compare.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def grammar_sizes(symbols: np.ndarray, lengths: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(length of the start rule, number of rules) per sequence; ``symbols`` holds all, end to end."""
    return _reduced(symbols, lengths)[:2]


def grammar_rules(tokens: np.ndarray, lengths: Sequence[int], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, hash of the expanded rule, tokens) of each rule of ``least`` tokens or more.

    ``tokens`` holds a stable 64-bit hash of each token text. A token counts once, at the smallest
    of these rules that it stands in. Symbols are ranked by hash, so equal sequences give equal
    rules whatever stands beside them.
    """
    h = np.asarray(tokens, dtype=np.uint64)
    found = _reduced(np.unique(h, return_inverse=True)[1], lengths, h, least)[2]
    f, key, size = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    order = np.lexsort((key, f))
    f, key, size = f[order], key[order], size[order]
    first = np.flatnonzero(np.r_[True, (f[1:] != f[:-1]) | (key[1:] != key[:-1])]) if len(f) else np.zeros(0, np.int64)
    return f[first], key[first], np.add.reduceat(size, first) if len(f) else size


def _reduced(symbols: np.ndarray, lengths: Sequence[int], hashes: np.ndarray | None = None, least: int = 2) -> tuple[np.ndarray, np.ndarray, list]:
    """Start lengths, numbers of rules and, with ``hashes``, (sequences, expanded hashes, tokens) of each round's replaced pairs."""
    n, found = len(lengths), []
    if hashes is not None:
        h, size_of = hashes.copy(), np.ones(len(hashes), dtype=np.int64)
        power = np.cumprod(np.full(max([*lengths, 0]) + 1, _BASE, dtype=np.uint64)) * _BASE_INVERSE
    s = np.asarray(symbols, dtype=np.int64).copy()
    f = np.repeat(np.arange(n, dtype=np.int64), lengths)
    rules = np.zeros(n, dtype=np.int64)
    fresh = int(s.max()) + 1 if len(s) else 0
    # a pair that occurs once never comes to occur twice: it is untied, and symbols that are tied to nothing are only counted
    tied, single = np.append(f[:-1] == f[1:], False)[: len(f)], np.zeros(n, dtype=np.int64)
    while len(s) > 1:
        at = np.flatnonzero(tied)
        if not len(at):
            break
        if fresh >= 1 << 20:
            s = np.unique(s, return_inverse=True)[1].astype(np.int64)
            fresh = int(s.max()) + 1
        pair = s[at] * np.int64(fresh) + s[at + 1]
        order = np.lexsort((pair, f[at]))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (pair[order][1:] != pair[order][:-1]) | (f[at][order][1:] != f[at][order][:-1])
        group = np.empty(len(order), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        count = np.bincount(group)[group]
        tied[at[count < 2]] = False
        most = np.zeros(n, dtype=np.int64)
        np.maximum.at(most, f[at], count)
        take = (count >= 2) & (2 * count > most[f[at]])
        where, rank = at[take], (count * np.int64(len(order) + 1) + group)[take]
        if not len(where):
            break
        near = np.full(len(s) + 2, -1, dtype=np.int64)
        near[where + 1] = rank
        win = (rank >= near[where]) & (rank >= near[where + 2])
        where, rank = where[win], rank[win]
        first = np.ones(len(where), dtype=bool)
        first[1:] = where[1:] != where[:-1] + 1
        run = np.cumsum(first) - 1
        keep = (np.arange(len(where)) - np.flatnonzero(first)[run]) % 2 == 0
        where, rank = where[keep], rank[keep]
        _, inverse, size = np.unique(rank, return_inverse=True, return_counts=True)
        twice = size[inverse] >= 2
        where, rank = where[twice], rank[twice]
        if not len(where):
            break
        _, index, inverse = np.unique(rank, return_index=True, return_inverse=True)
        s[where] = fresh + inverse
        fresh += len(index)
        rules += np.bincount(f[where[index]], minlength=n)
        if hashes is not None:
            a, b = size_of[where], size_of[where + 1]
            h[where] = h[where] * power[b] + h[where + 1]
            size_of[where] = a + b
            own = np.where(a < least, a, 0) + np.where(b < least, b, 0)
            new = (a + b >= least) & (own > 0)
            found.append((f[where][new], h[where][new], own[new]))
        tied[where] = tied[where + 1]
        stay = tied.copy()
        stay[1:] |= tied[:-1]
        stay[where + 1] = False
        gone = ~stay
        gone[where + 1] = False
        single += np.bincount(f[gone], minlength=n)
        s, f, tied = s[stay], f[stay], tied[stay]
        if hashes is not None:
            h, size_of = h[stay], size_of[stay]
    return np.bincount(f, minlength=n) + single if n else np.zeros(0, dtype=np.int64), rules, found
