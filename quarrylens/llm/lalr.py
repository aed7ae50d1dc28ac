"""Table-driven parsing: LALR(1) tables from a grammar text, and the driver that runs a token stream over them.

Grammar text: one rule a line, ``name: symbols... | symbols...``; further lines that start with ``|`` go on
with the rule; an empty alternative is the empty word; terminals are in quotes or upper case. ``@name``
after an alternative names its action, ``%left``, ``%right`` lines give precedence from low to high, and
``%prec TOKEN`` after an alternative sets its own.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable

END = "$end"


class ParseError(Exception):
    """The first error that no continuation of the file can repair: where, and what was wrong."""

    def __init__(self, at: int, what: str):
        super().__init__(what)
        self.at, self.what = at, what


class Grammar:
    def __init__(self, text: str):
        self.rules: list[tuple[str, tuple[str, ...], str | None]] = []
        self.prec: dict[str, tuple[int, str]] = {}
        self.rule_prec: dict[int, tuple[int, str]] = {}
        level, name = 0, ""
        for line in text.splitlines():
            line = line.strip()
            if not line or line.startswith("#"):
                continue
            if line[0] == "%":
                kind, *toks = line[1:].split()
                level += 1
                for t in toks:
                    self.prec[t.strip("'") if len(t) > 2 else t] = (level, kind)
                continue
            if not line.startswith("|"):
                name, _, line = line.partition(":")
                name = name.strip()
            else:
                line = line[1:]
            for alt in re.split(r"\s\|(?=\s|$)", " " + line):
                syms, action, prec = [], None, None
                toks = iter(alt.split())
                for t in toks:
                    if t[0] == "@" and len(t) > 1:
                        action = t[1:]
                    elif t == "%prec":
                        prec = self.prec[next(toks).strip("'")]
                    else:
                        syms.append(t[1:-1] if t[0] == "'" else t)
                n = len(self.rules)
                self.rules.append((name, tuple(syms), action))
                if prec is None:
                    known = [self.prec[s] for s in syms if s in self.prec]
                    prec = known[-1] if known else None
                if prec:
                    self.rule_prec[n] = prec
        self.start = self.rules[0][0]
        self.nonterminals = {r[0] for r in self.rules}


class Tables:
    """ACTION and GOTO of a grammar. Conflicts without precedence are an error: a bundled grammar has none."""

    def __init__(self, g: Grammar):
        rules = [("$accept", (g.start, END), None), *g.rules]
        prec = {k + 1: v for k, v in g.rule_prec.items()}
        by_name = defaultdict(list)
        for i, r in enumerate(rules):
            by_name[r[0]].append(i)
        nts = set(by_name)
        nullable: set[str] = set()
        first: dict[str, set] = defaultdict(set)
        changed = True
        while changed:
            changed = False
            for lhs, rhs, _ in rules:
                if lhs not in nullable and all(s in nullable for s in rhs):
                    nullable.add(lhs)
                    changed = True
                for s in rhs:
                    add = first[s] if s in nts else {s}
                    if not add <= first[lhs]:
                        first[lhs] |= add
                        changed = True
                    if s not in nullable:
                        break

        # LR(0) states by kernel
        def closure(kernel):
            items, todo = set(kernel), list(kernel)
            while todo:
                r, d = todo.pop()
                rhs = rules[r][1]
                if d < len(rhs) and rhs[d] in nts:
                    for n in by_name[rhs[d]]:
                        if (n, 0) not in items:
                            items.add((n, 0))
                            todo.append((n, 0))
            return items

        states, index, moves = [frozenset([(0, 0)])], {frozenset([(0, 0)]): 0}, []
        closures = []
        k = 0
        while k < len(states):
            full = closure(states[k])
            closures.append(full)
            to = defaultdict(set)
            for r, d in full:
                rhs = rules[r][1]
                if d < len(rhs):
                    to[rhs[d]].add((r, d + 1))
            row = {}
            for s, kern in sorted(to.items()):
                kern = frozenset(kern)
                if kern not in index:
                    index[kern] = len(states)
                    states.append(kern)
                row[s] = index[kern]
            moves.append(row)
            k += 1

        # Lookaheads by relations over nonterminal transitions: reads, includes, lookback
        trans = [(p, a) for p, row in enumerate(moves) for a in row if a in nts]
        num = {t: i for i, t in enumerate(trans)}
        reads: list[list[int]] = [[] for _ in trans]
        sets: list[set] = [set() for _ in trans]
        for i, (p, a) in enumerate(trans):
            q = moves[p][a]
            for s in moves[q]:
                if s in nts:
                    if s in nullable:
                        reads[i].append(num[q, s])
                else:
                    sets[i].add(s)
        self._spread(sets, reads)
        includes: list[list[int]] = [[] for _ in trans]
        lookback: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i, (p, a) in enumerate(trans):
            for r in by_name[a]:
                q, rhs = p, rules[r][1]
                for d, s in enumerate(rhs):
                    if s in nts and all(x in nullable for x in rhs[d + 1 :]):
                        includes[num[q, s]].append(i)
                    q = moves[q][s]
                lookback[q, r].append(i)
        self._spread(sets, includes)

        self.rules = rules
        self.access = [next((rules[r][1][d - 1] for r, d in st), None) for st in states]
        self.action: list[dict[str, int]] = []
        self.goto: list[dict[str, int]] = []
        for p, row in enumerate(moves):
            act: dict[str, int] = {s: q for s, q in row.items() if s not in nts}
            for r, d in closures[p]:
                if r and d == len(rules[r][1]):
                    for la in set().union(*(sets[i] for i in lookback[p, r])):
                        if la not in act:
                            act[la] = -r
                            continue
                        have = act[la]
                        if have > 0 and r in prec and la in g.prec:
                            if prec[r][0] > g.prec[la][0] or (prec[r][0] == g.prec[la][0] and g.prec[la][1] == "left"):
                                act[la] = -r
                        else:
                            raise ValueError(f"conflict on {la}: {rules[r]} and {rules[-have] if have < 0 else 'shift'}")
            self.action.append(act)
            self.goto.append({s: q for s, q in row.items() if s in nts})
        self.lhs = [r[0] for r in rules]
        self.size = [len(r[1]) for r in rules]
        self.names = [r[2] for r in rules]

    @staticmethod
    def _spread(sets: list[set], edges: list[list[int]]) -> None:
        """sets[i] |= sets[j] along edges, to the fixed point."""
        back = defaultdict(list)
        for i, js in enumerate(edges):
            for j in js:
                back[j].append(i)
        todo = list(range(len(sets)))
        while todo:
            j = todo.pop()
            for i in back[j]:
                if not sets[j] <= sets[i]:
                    sets[i] |= sets[j]
                    todo.append(i)


def parse(t: Tables, tokens: Iterable[tuple[str, int, object]], actions: dict[str, Callable]) -> object:
    """Run ``(terminal, place, value)`` tokens, ended by END, over the tables; the start symbol's value.

    An action gets ``(values, place, below, lookahead)``: the values of its symbols, the place of the current
    token, the symbol below them on the stack and the next terminal. A rule of one symbol without an action
    hands its value on, any other gives 0.
    """
    action, goto, lhs, size = t.action, t.goto, t.lhs, t.size
    acts = [actions[n] if n else None for n in t.names]
    states, values = [0], []
    state = 0
    for kind, at, value in tokens:
        while True:
            a = action[state].get(kind)
            if a is None:
                want = sorted(action[state])
                raise ParseError(at, f"unexpected {kind}, expected " + (" or ".join(want[:4]) + (" ..." if len(want) > 4 else "")))
            if a >= 0:
                if kind == END:
                    return values[-1]
                states.append(a)
                values.append(value)
                state = a
                break
            r = -a
            n, act = size[r], acts[r]
            if act is not None:
                got = values[len(values) - n :] if n else []
                below = t.access[states[-n - 1]] if n else t.access[state]
                new = act(got, at, below, kind)
            elif n == 1:
                # one symbol: the value stays as it is
                states.pop()
                state = goto[states[-1]][lhs[r]]
                states.append(state)
                continue
            else:
                new = 0
            if n:
                del states[-n:], values[-n:]
            state = goto[states[-1]][lhs[r]]
            states.append(state)
            values.append(new)
    raise ParseError(-1, "the token stream has no end")
