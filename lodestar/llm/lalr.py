"""LALR(1) tables from grammar texts, and a parser that remembers how lines move its stack.

Grammar text: ``name : part part | part ;`` per rule, the first rule being the start. Parts are
terminals ('x' or UPPER) or rule names, with ``?``, ``*``, ``+`` behind, and ``{part sep}`` for one
or more parts between separators. Look-aheads follow DeRemer and Pennello; a shift is preferred
to a reduction, and of two reductions the rule written first.

The parser takes a file as lines of one-character terminals. What a line does depends only on the
states that it looks at on top of the stack, so its effect is kept under these and used again: a
line of known shape costs one look-up, whatever its length. The result is that of the tables.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field

END = "\x02"  # the terminal after the last line, for tables over characters
_PARTS = re.compile(r"'[^']+'|\{|\}|[A-Za-z_]\w*|[?*+|:;]")


class Grammar:
    def __init__(self, text: str) -> None:
        self.rules: list[tuple[str, tuple[str, ...]]] = []
        self._made: dict[tuple, str] = {}
        toks = _PARTS.findall(re.sub(r"(?m)^\s*--.*$", "", text))
        i = 0
        names = []
        bodies: dict[str, list[list[str]]] = {}
        while i < len(toks):
            name, i = toks[i], i + 2
            alts: list[list[str]] = [[]]
            while toks[i] != ";":
                if toks[i] == "|":
                    alts.append([])
                    i += 1
                    continue
                if toks[i] == "{":
                    sym, sep = toks[i + 1], toks[i + 2]
                    i += 4
                    sym = self._many(sym, sep, bodies)
                else:
                    sym = toks[i]
                    i += 1
                while i < len(toks) and toks[i] in "?*+":
                    sym = self._repeat(sym, toks[i], bodies)
                    i += 1
                alts[-1].append(sym)
            i += 1
            names.append(name)
            bodies.setdefault(name, []).extend(alts)
        start = names[0]
        order = [*dict.fromkeys(names), *[n for n in bodies if n not in names]]
        self.rules.append(("$start", (start,)))
        for n in order:
            self.rules += [(n, tuple(a)) for a in bodies[n]]
        self.nonterminals = {n for n, _ in self.rules}
        self.terminals = {s for _, r in self.rules for s in r if s not in self.nonterminals}

    def _repeat(self, sym: str, how: str, bodies: dict) -> str:
        name = self._made.setdefault((sym, how), f"${len(self._made)}")
        if name not in bodies:
            bodies[name] = {"?": [[], [sym]], "*": [[], [name, sym]], "+": [[sym], [name, sym]]}[how]
        return name

    def _many(self, sym: str, sep: str, bodies: dict) -> str:
        name = self._made.setdefault((sym, sep), f"${len(self._made)}")
        bodies.setdefault(name, [[sym], [name, sep, sym]])
        return name


def _digraph(nodes, edges, value):
    """Union of value over all nodes reached by edges (Tarjan's components)."""
    low, stack, out = dict.fromkeys(nodes, 0), [], {}
    for root in nodes:
        if low[root]:
            continue
        work = [(root, iter(edges.get(root, ())))]
        stack.append(root)
        low[root] = depth = len(stack)
        out[root] = set(value.get(root, ()))
        depths = {root: depth}
        while work:
            x, it = work[-1]
            for y in it:
                if not low[y]:
                    stack.append(y)
                    low[y] = len(stack)
                    depths[y] = low[y]
                    out[y] = set(value.get(y, ()))
                    work.append((y, iter(edges.get(y, ()))))
                    break
                low[x] = min(low[x], low[y])
                out[x] |= out[y]
            else:
                work.pop()
                if work:
                    p = work[-1][0]
                    low[p] = min(low[p], low[x])
                    out[p] |= out[x]
                if low[x] == depths[x]:
                    while True:
                        y = stack.pop()
                        low[y] = 1 << 30
                        out[y] = out[x]
                        if y == x:
                            break
    return out


@dataclass
class Tables:
    """action[state][terminal]: next state, or -1 - rule; goto[state][name]; rules: (name, length)."""

    action: list[dict[str, int]]
    goto: list[dict[str, int]]
    rules: list[tuple[str, int]]
    accept: int
    asi: str | None = None
    restricted: str = ""
    memo: dict = field(default_factory=dict)


def build(text: str) -> Tables:
    g = Grammar(text)
    rules, nts = g.rules, g.nonterminals
    by_name = defaultdict(list)
    for i, (n, _) in enumerate(rules):
        by_name[n].append(i)
    nullable: set[str] = set()
    while True:
        more = {n for n, r in rules if n not in nullable and all(s in nullable for s in r)}
        if not more:
            break
        nullable |= more
    closure_of: dict[str, frozenset] = {}
    for n in nts:
        seen, todo = set(), [n]
        while todo:
            x = todo.pop()
            for i in by_name[x]:
                if i not in seen:
                    seen.add(i)
                    r = rules[i][1]
                    if r and r[0] in nts:
                        todo.append(r[0])
        closure_of[n] = frozenset(seen)
    start = frozenset({(0, 0)})
    states, number, trans = [start], {start: 0}, []
    for kernel in states:
        items = set(kernel)
        for i, d in kernel:
            r = rules[i][1]
            if d < len(r) and r[d] in nts:
                items |= {(j, 0) for j in closure_of[r[d]]}
        moves = defaultdict(set)
        for i, d in items:
            r = rules[i][1]
            if d < len(r):
                moves[r[d]].add((i, d + 1))
        row = {}
        for s, k in moves.items():
            k = frozenset(k)
            if k not in number:
                number[k] = len(states)
                states.append(k)
            row[s] = number[k]
        trans.append(row)
    nt_moves = [(p, s) for p, row in enumerate(trans) for s in row if s in nts]
    reads_value, reads, includes, look = {}, defaultdict(list), defaultdict(list), defaultdict(list)
    for p, a in nt_moves:
        q = trans[p][a]
        reads_value[p, a] = {s for s in trans[q] if s not in nts}
        reads[p, a] = [(q, s) for s in trans[q] if s in nullable]
        for i in by_name[a]:
            r, s = rules[i][1], p
            for k, x in enumerate(r):
                if x in nts and all(y in nullable for y in r[k + 1 :]):
                    includes[s, x].append((p, a))
                s = trans[s][x]
            look[s, i].append((p, a))
    reads_value[0, rules[0][1][0]] = reads_value.get((0, rules[0][1][0]), set()) | {"$"}
    follow = _digraph(nt_moves, includes, _digraph(nt_moves, reads, reads_value))
    action: list[dict[str, int]] = []
    for p, kernel in enumerate(states):
        row = {s: q for s, q in trans[p].items() if s not in nts}
        done = {i for i, d in kernel if d == len(rules[i][1])}
        for i, d in kernel:
            r = rules[i][1]
            if d < len(r) and r[d] in nts:
                done |= {j for j in closure_of[r[d]] if not rules[j][1]}
        if p == 0:
            done |= {j for j in closure_of["$start"] if not rules[j][1]}
        for i in sorted(done):
            if i == 0:
                row.setdefault("$", -1)
                continue
            for pa in look[p, i]:
                for t in follow[pa]:
                    row.setdefault(t, -1 - i)
        action.append(row)
    goto = [{s: q for s, q in row.items() if s in nts} for row in trans]
    return Tables(action, goto, [(n, len(r)) for n, r in rules], 0)


def with_characters(tables: Tables, char: dict[str, str], asi: str | None) -> Tables:
    """The same tables over one-character terminals; ``asi``: the sign a parser may add at line ends."""
    action = [{char.get(t, t): v for t, v in row.items()} for row in tables.action]
    return Tables(action, tables.goto, tables.rules, 0, char.get(asi) if asi else None)


def _advance(t: Tables, stack: list[int], line: str, fresh: bool, close: str) -> tuple[list[int], int] | int:
    """Run one line: (states that replace the top ones, how many are replaced), or the index of the error."""
    action, goto, rules, asi = t.action, t.goto, t.rules, t.asi
    own: list[int] = []
    below = len(stack) - 1
    own.append(stack[below])
    i, n = 0, len(line)
    added = -1
    while i < n:
        c = line[i]
        a = action[own[-1]].get(c)
        if a is None or i == 0 and fresh and c == t.restricted and added != 0 and asi in action[own[-1]]:
            if asi is None or added == i or not (i == 0 and fresh or c in close):
                return i
            a = action[own[-1]].get(asi)
            if a is None:
                return i
            if a >= 0:
                own.append(a)
                added = i
                continue
        if a >= 0:
            own.append(a)
            i += 1
            continue
        if a == -1:
            i += 1
            continue
        name, length = rules[-1 - a]
        while length >= len(own):
            below -= 1
            own.insert(0, stack[below])
        if length:
            del own[-length:]
        own.append(goto[own[-1]][name])
    return own, len(stack) - below


def parse(t: Tables, lines: list[tuple[int, str]], close: str = "") -> tuple[int, int] | None:
    """None if the file is a sentence of the grammar, else (line number, token index) of the first error."""
    stack = [0]
    memo = t.memo
    if len(memo) > 400_000:
        memo.clear()
    last = 0
    for at, (no, line) in enumerate([*lines, (-1, END)]):
        if not line:
            continue
        head = (line, stack[-1], at > 0)
        for k in memo.get(head, ()):
            if k <= len(stack) and (new := memo.get((head, tuple(stack[-k:])))) is not None:
                break
        else:
            done = _advance(t, stack, line, at > 0, close + END)
            if isinstance(done, int):
                return (no if no >= 0 else last), done
            new, k = done
            new = tuple(new)
            if len(line) < 400:
                known = memo.setdefault(head, [])
                if k not in known:
                    known.append(k)
                memo[head, tuple(stack[-k:])] = new
        stack[-k:] = new
        last = no
    return None
