"""Recognising token streams by memoised derivatives of grammars.

A grammar is a set of hash-consed nodes: a token, a sequence, an alternative, a repetition, a guard (its first
token may not be one of some) or a named rule. The derivative of a node by a token is the node of what may
follow; the empty node means that the token cannot stand there. Derivatives are kept on the nodes, and as equal
nodes are one object, the automaton that arises serves all files a worker sees: a token that was met before in
the same state costs one dictionary look-up. Alternatives with a common head or a common tail are factored, so
ambiguous readings share what follows and their number does not grow with nesting.

Grammars are given as text (see `Grammar`) and must not be left-recursive.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

#: Nodes beyond this number are forgotten (not the grammar's own); bounds a worker's memory.
MOST_NODES = 400_000


class Node:
    """A hash-consed grammar node. `d` holds the derivatives taken so far."""

    __slots__ = ("kind", "a", "b", "nullable", "d")

    def __init__(self, kind: str, a, b, nullable: bool):
        self.kind, self.a, self.b, self.nullable = kind, a, b, nullable
        self.d: dict[str, Node] = {}


class Grammar:
    """A grammar from rules `Name = body ;` where a body has 'tokens', NAMES of rules or token classes, sequences,
    `|`, `( )`, `[ ]` for optional and `{ }` for repeated parts, and `!('a' 'b') X` for an X that does not begin
    with one of those tokens. Names that are no rules are token classes.
    """

    TOKENS = re.compile(r"\s*(?:(?P<q>'[^']*')|(?P<n>[A-Za-z_]\w*)|(?P<p>[=|()\[\]{};!]))")

    def __init__(self, text: str, start: str, words: Iterable[str] = ()):
        self.table: dict[tuple, Node] = {}
        self.empty = Node("empty", None, None, False)
        self.eps = Node("eps", None, None, True)
        self.rules: dict[str, Node] = {}
        self.bodies: dict[str, Node] = {}
        self.words = list(words)
        self._read(text)
        self._settle()
        self.start = self.rules[start]
        self.kept = dict(self.table)

    # construction

    def _make(self, kind: str, a, b, nullable: bool, key: tuple) -> Node:
        node = self.table.get(key)
        if node is None:
            node = self.table[key] = Node(kind, a, b, nullable)
        return node

    def tok(self, t: str) -> Node:
        return self._make("tok", t, None, False, ("t", t))

    def seq(self, a: Node, b: Node) -> Node:
        if a is self.empty or b is self.empty:
            return self.empty
        if a is self.eps:
            return b
        if b is self.eps:
            return a
        if a.kind == "seq":  # to the right, so that the head is at hand
            return self.seq(a.a, self.seq(a.b, b))
        return self._make("seq", a, b, a.nullable and b.nullable, ("s", id(a), id(b)))

    def alt(self, parts: Iterable[Node]) -> Node:
        flat: dict[int, Node] = {}
        todo = list(parts)
        while todo:
            p = todo.pop()
            if p.kind == "alt":
                todo.extend(p.a)
            elif p is not self.empty:
                flat[id(p)] = p
        if not flat:
            return self.empty
        if len(flat) == 1:
            return next(iter(flat.values()))
        heads: dict[int, list[Node]] = {}
        for p in flat.values():
            heads.setdefault(id(p.a) if p.kind == "seq" else -id(p), []).append(p)
        if len(heads) < len(flat):
            return self.alt([g[0] if len(g) == 1 else self.seq(g[0].a, self.alt([p.b for p in g])) for g in heads.values()])
        tails: dict[int, list[Node]] = {}
        for p in flat.values():
            tails.setdefault(id(p.b) if p.kind == "seq" else -id(p), []).append(p)
        if len(tails) < len(flat):
            return self.alt([g[0] if len(g) == 1 else self._factored(g) for g in tails.values()])
        members = tuple(flat[k] for k in sorted(flat))
        return self._make("alt", members, None, any(p.nullable for p in members), ("a", *sorted(flat)))

    def _factored(self, group: list[Node]) -> Node:
        head = self.alt([p.a for p in group])
        tail = group[0].b
        if head.kind == "seq":
            return self.seq(head, tail)
        return self._make("seq", head, tail, head.nullable and tail.nullable, ("s", id(head), id(tail)))

    def star(self, a: Node) -> Node:
        return self._make("star", a, None, True, ("r", id(a)))

    def guard(self, no: frozenset, a: Node) -> Node:
        return self._make("guard", a, no, a.nullable, ("g", no, id(a)))

    def _rule(self, name: str) -> Node:
        if name not in self.rules:
            self.rules[name] = Node("rule", name, None, False)
        return self.rules[name]

    def _read(self, text: str) -> None:
        text = re.sub(r"(?m)^\s*--.*$", "", text)
        items, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = self.TOKENS.match(text, at)
            if not m:
                raise ValueError(f"grammar: {text[at : at + 40]!r}")
            items.append(m.group(m.lastgroup))
            at = m.end()
        names = {items[i] for i in range(len(items) - 1) if items[i + 1] == "=" and (i == 0 or items[i - 1] == ";")}
        pos = 0

        def alternatives(end: str) -> Node:
            nonlocal pos
            parts = [sequence()]
            while items[pos] == "|":
                pos += 1
                parts.append(sequence())
            if items[pos] != end:
                raise ValueError(f"grammar: {items[pos]!r} where {end!r} is expected, after {items[max(0, pos - 8) : pos]}")
            pos += 1
            # plain: rules are not resolved yet, so nothing may be judged nullable here
            return parts[0] if len(parts) == 1 else Node("alt", tuple(parts), None, False)

        def sequence() -> Node:
            nonlocal pos
            parts: list[Node] = []
            while items[pos] not in ("|", ")", "]", "}", ";"):
                parts.append(atom())
            out = self.eps
            for p in reversed(parts):
                out = p if out is self.eps else Node("seq", p, out, False)
            return out

        def atom() -> Node:
            nonlocal pos
            x = items[pos]
            pos += 1
            if x[0] == "'":
                return self.tok(x[1:-1])
            if x == "(":
                return alternatives(")")
            if x == "[":
                return Node("alt", (self.eps, alternatives("]")), None, True)
            if x == "{":
                return Node("star", alternatives("}"), None, True)
            if x == "!":
                pos += 1
                no = []
                while items[pos] != ")":
                    no.append(items[pos][1:-1])
                    pos += 1
                pos += 1
                return Node("guard", atom(), frozenset(no), False)
            if x == "WORD":
                return Node("alt", tuple(self.tok(w) for w in ["ID", *self.words]), None, False)
            return self._rule(x) if x in names else self.tok(x)

        while pos < len(items):
            name = items[pos]
            pos += 2
            if name in self.bodies:
                raise ValueError(f"grammar: {name} is defined twice")
            self.bodies[name] = alternatives(";")
            self._rule(name)

    def _settle(self) -> None:
        """Finds which rules can be empty, then hash-conses all bodies."""
        can = dict.fromkeys(self.bodies, False)

        def nullable(n: Node) -> bool:
            if n.kind == "rule":
                return can[n.a]
            if n.kind == "seq":
                return nullable(n.a) and nullable(n.b)
            if n.kind == "alt":
                return any(nullable(x) for x in n.a)
            if n.kind == "guard":
                return nullable(n.a)
            return n.kind in ("eps", "star")

        changed = True
        while changed:
            changed = False
            for name, body in self.bodies.items():
                if not can[name] and nullable(body):
                    can[name] = changed = True
        for name, node in self.rules.items():
            node.nullable = can[name]

        def build(n: Node) -> Node:
            if n.kind == "seq":
                return self.seq(build(n.a), build(n.b))
            if n.kind == "alt":
                return self.alt([build(x) for x in n.a])
            if n.kind == "star":
                return self.star(build(n.a))
            if n.kind == "guard":
                return self.guard(n.b, build(n.a))
            return n

        for name in self.bodies:
            self.bodies[name] = build(self.bodies[name])
        self._refuse_left_recursion()

    def _refuse_left_recursion(self) -> None:
        done: set[str] = set()

        def first_rules(n: Node) -> set[str]:
            if n.kind == "rule":
                return {n.a}
            if n.kind == "seq":
                return first_rules(n.a) | (first_rules(n.b) if n.a.nullable else set())
            if n.kind == "alt":
                return set().union(*(first_rules(x) for x in n.a))
            return first_rules(n.a) if n.kind in ("star", "guard") else set()

        def walk(name: str, path: tuple[str, ...]) -> None:
            if name in path:
                raise ValueError(f"grammar: left recursion {' > '.join([*path, name])}")
            if name in done:
                return
            for other in first_rules(self.bodies[name]):
                walk(other, (*path, name))
            done.add(name)

        for name in self.bodies:
            walk(name, ())

    # derivatives

    def derive(self, n: Node, t: str) -> Node:
        """What may follow the token t at n; `empty` if t cannot stand there."""
        found = n.d.get(t)
        if found is not None:
            return found
        kind = n.kind
        if kind == "tok":
            out = self.eps if n.a == t else self.empty
        elif kind == "seq":
            out = self.seq(self.derive(n.a, t), n.b)
            if n.a.nullable:
                out = self.alt((out, self.derive(n.b, t)))
        elif kind == "alt":
            out = self.alt([x for p in n.a if (x := self.derive(p, t)) is not self.empty])
        elif kind == "star":
            out = self.seq(self.derive(n.a, t), n)
        elif kind == "rule":
            out = self.derive(self.bodies[n.a], t)
        elif kind == "guard":
            out = self.empty if t in n.b else self.derive(n.a, t)
        else:
            out = self.empty
        n.d[t] = out
        return out

    def trim(self) -> None:
        """Forgets all nodes that arose from texts, if they are too many. A node in use stays valid: it holds its parts;
        equal nodes may exist twice afterwards, which costs sharing only."""
        if len(self.table) > MOST_NODES:
            self.table = dict(self.kept)
            for node in [*self.kept.values(), *self.rules.values()]:
                node.d = {}

    def recognise(self, tokens: Sequence[str], can_end: Sequence[bool] | None = None, filler: str | None = None) -> int | None:
        """The index of the token that cannot stand where it stands, len(tokens) if more must follow the last one,
        or None if the tokens are a sentence of the grammar.

        Where a token cannot stand and `can_end` allows it there, the token `filler` is put before it first; at
        the end of the tokens it may be put too.
        """
        state = self.start
        derive, empty = self.derive, self.empty
        for k, t in enumerate(tokens):
            if not k & 1023:
                self.trim()  # the state and what it leads to stay, as it holds them
            nxt = state.d.get(t)
            if nxt is None:
                nxt = derive(state, t)
            if nxt is empty:
                if filler is None or not can_end[k]:
                    return k
                nxt = derive(state, filler)
                if nxt is empty or (nxt := derive(nxt, t)) is empty:
                    return k
            state = nxt
        if state.nullable or (filler is not None and derive(state, filler).nullable):
            return None
        return len(tokens)
