"""Generalised LL recognition with a graph-structured stack.

Grammars are written in a small EBNF: ``Name := a 'b' (c | d)* e? ;``. Quoted symbols and lower-case names are
terminals, capitalised names with a rule are nonterminals. A token is a string; it matches a terminal of the
same name, and a token that carries several readings (``id|async``, ``{BLOCK|OBJ}``) matches each of them.
"""

from __future__ import annotations

import re
from collections import defaultdict

_LEX = re.compile(r"'[^']+'|:=|[A-Za-z_][\w]*|[()|*+?;]")
END = "$"


class Grammar:
    def __init__(self, text: str, readings: dict[str, tuple[str, ...]] | None = None):
        #: readings: further terminals a token stands for (a soft keyword is an identifier too)
        self.readings = readings or {}
        self.rules: dict[str, list[tuple[str, ...]]] = {}
        self.fresh = 0
        toks = _LEX.findall(text)
        at = 0
        while at < len(toks):
            name = toks[at]
            if toks[at + 1] != ":=":
                raise ValueError(f"rule expected at {toks[at : at + 4]}")
            alts, at = self._alts(toks, at + 2)
            self.rules.setdefault(name, []).extend(alts)
            at += 1  # ;
        self._known: dict[str, frozenset[str]] = {}
        self._firsts()

    def _alts(self, toks, at):
        alts, cur = [], []
        while True:
            t = toks[at]
            if t in (";", ")"):
                alts.append(tuple(cur))
                return alts, at
            if t == "|":
                alts.append(tuple(cur))
                cur = []
                at += 1
                continue
            if t == "(":
                inner, at = self._alts(toks, at + 1)
                sym = self._new(inner)
            else:
                sym = t[1:-1] if t[0] == "'" else t
            at += 1
            if at < len(toks) and toks[at] in "*+?":
                op = toks[at]
                at += 1
                if op == "?":
                    sym = self._new([(sym,), ()])
                elif op == "*":
                    sym = self._loop(sym)
                else:
                    cur.append(sym)
                    sym = self._loop(sym)
            cur.append(sym)

    def _new(self, alts) -> str:
        self.fresh += 1
        name = f"_{self.fresh}"
        self.rules[name] = list(alts)
        return name

    def _loop(self, sym) -> str:
        name = self._new([])
        self.rules[name] = [(name, sym), ()]  # left recursion: one stack node for all rounds
        return name

    def _firsts(self) -> None:
        self.nullable: set[str] = set()
        self.first: dict[str, set[str]] = defaultdict(set)
        grew = True
        while grew:
            grew = False
            for name, alts in self.rules.items():
                for alt in alts:
                    f, null = self._first_of(alt)
                    if not f <= self.first[name]:
                        self.first[name] |= f
                        grew = True
                    if null and name not in self.nullable:
                        self.nullable.add(name)
                        grew = True
        # grammar slots as numbers: slot k is a dot before symbol[k]; the slot after it is k + 1
        self.number = {n: i for i, n in enumerate(self.rules)}
        self.symbol: list = []  # nonterminal number, terminal, or None at the end of an alternative
        self.first_of_slot: list[frozenset] = []
        self.null_slot: list[bool] = []
        self.starts: list[list[int]] = [[] for _ in self.rules]
        for name, alts in self.rules.items():
            for alt in alts:
                self.starts[self.number[name]].append(len(self.symbol))
                for dot in range(len(alt) + 1):
                    f, null = self._first_of(alt[dot:])
                    self.first_of_slot.append(frozenset(f))
                    self.null_slot.append(null)
                    self.symbol.append(None if dot == len(alt) else self.number.get(alt[dot], alt[dot]))
        self._can: dict[tuple[int, str], bool] = {}
        self._begin: dict[tuple[int, str], list[int]] = {}

    def _first_of(self, alt):
        out: set[str] = set()
        for s in alt:
            if s in self.rules:
                out |= self.first[s]
                if s not in self.nullable:
                    return out, False
            else:
                out.add(s)
                return out, False
        return out, True

    def terminals(self, token: str) -> frozenset[str]:
        k = self._known.get(token)
        if k is None:
            if token[0] == "{" and len(token) > 1:
                k = frozenset(token[1:-1].split("|"))
            else:
                k = frozenset((token, *self.readings.get(token, ())))
            if len(self._known) < 100_000:
                self._known[token] = k
        return k

    def _able(self, slot: int, token: str) -> bool:
        """Whether what follows a slot can begin with the token (or be empty)."""
        key = (slot, token)
        got = self._can.get(key)
        if got is None:
            got = self._can[key] = self.null_slot[slot] or not self.first_of_slot[slot].isdisjoint(self.terminals(token))
        return got

    def accepts(self, start: str, tokens) -> bool:
        """Whether start derives the whole token sequence (descriptors worked off from a graph-structured stack)."""
        toks = [*tokens, END]
        terms = [self.terminals(t) for t in toks]
        n = len(tokens)
        wide = n + 1
        symbol, able, can = self.symbol, self._able, self._can
        # a stack node is nonterminal * wide + position; an edge is (slot to go on from, parent node)
        edges: dict[int, set] = {}
        popped: dict[int, set[int]] = {}
        todo: list = []
        seen: set = set()
        root = self.number[start] * wide
        begin = self._begin

        def add(slot, node, i):
            ok = can.get((slot, toks[i]))
            if ok is None:
                ok = able(slot, toks[i])
            if ok:
                d = (slot, node, i)
                if d not in seen:
                    seen.add(d)
                    todo.append(d)

        def enter(nt, node, i):
            key = (nt, toks[i])
            slots = begin.get(key)
            if slots is None:
                slots = begin[key] = [k for k in self.starts[nt] if able(k, toks[i])]
            for k in slots:
                d = (k, node, i)
                seen.add(d)
                todo.append(d)

        edges[root], popped[root] = set(), set()
        enter(self.number[start], root, 0)
        while todo:
            slot, node, i = todo.pop()
            while True:
                s = symbol[slot]
                if s is None:
                    if node == root and i == n:
                        return True
                    done = popped[node]
                    if i not in done:
                        done.add(i)
                        for back, parent in edges[node]:
                            add(back, parent, i)
                    break
                if s.__class__ is int:
                    child = s * wide + i
                    back = (slot + 1, node)
                    known = edges.get(child)
                    if known is None:
                        edges[child], popped[child] = {back}, set()
                        enter(s, child, i)
                    elif back not in known:
                        known.add(back)
                        for j in popped[child]:
                            add(slot + 1, node, j)
                    break
                if s not in terms[i]:
                    break
                slot += 1
                if s != END:
                    i += 1
        return False
