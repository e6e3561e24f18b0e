"""Byte automata built from rule expressions: parse, position-free NFA, subset construction, minimisation."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

ALL = frozenset(range(256))


@dataclass
class Nfa:
    """Byte transitions and empty moves of numbered states."""

    moves: list[list[tuple[frozenset[int], int]]] = field(default_factory=list)
    empty: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1


class Parser:
    """A small expression language over bytes: literals, escapes, classes, groups, `|`, `?`, `*`, `+`, `{m}`, `{m,n}`.

    parse() returns a tree of tuples: ("set", bytes), ("cat", items), ("alt", items), ("rep", item, least, most or None).
    """

    def __init__(self, source: str):
        self.source, self.at = source, 0

    def parse(self):
        tree = self.alternatives()
        if self.at != len(self.source):
            raise ValueError(f"unexpected {self.source[self.at]!r} at {self.at} in {self.source!r}")
        return tree

    def peek(self) -> str:
        return self.source[self.at] if self.at < len(self.source) else ""

    def take(self) -> str:
        c = self.peek()
        if not c:
            raise ValueError(f"{self.source!r} ends early")
        self.at += 1
        return c

    def alternatives(self):
        items = [self.sequence()]
        while self.peek() == "|":
            self.take()
            items.append(self.sequence())
        return items[0] if len(items) == 1 else ("alt", items)

    def sequence(self):
        items = []
        while self.peek() not in ("", "|", ")"):
            items.append(self.repeated(self.atom()))
        return ("cat", items)

    def repeated(self, item):
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                end = self.source.index("}", self.at)
                least, comma, most = self.source[self.at : end].partition(",")
                self.at = end + 1
                item = ("rep", item, int(least), int(most) if most else None if comma else int(least))
            else:
                item = ("rep", item, int(c == "+"), 1 if c == "?" else None)
        return item

    def atom(self):
        c = self.take()
        if c == "(":
            if self.source.startswith("?:", self.at):
                self.at += 2
            tree = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"a group of {self.source!r} isn't closed")
            return tree
        if c == "[":
            return ("set", self.char_class())
        if c == ".":
            return ("set", ALL - {10})
        if c == "\\":
            return ("set", frozenset({self.escape()}))
        if ord(c) > 127:
            return ("cat", [("set", frozenset({b})) for b in c.encode()])
        return ("set", frozenset({ord(c)}))

    def escape(self) -> int:
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.source[self.at - 2 : self.at], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def char_class(self) -> frozenset[int]:
        negated = self.peek() == "^"
        if negated:
            self.take()
        found: set[int] = set()
        first = True
        while first or self.peek() != "]":
            first = False
            low = self.escape() if (c := self.take()) == "\\" else ord(c)
            if self.peek() == "-" and self.source[self.at + 1 : self.at + 2] not in ("]", ""):
                self.take()
                high = self.escape() if (c := self.take()) == "\\" else ord(c)
                found.update(range(low, high + 1))
            else:
                found.add(low)
        self.take()
        return ALL - found if negated else frozenset(found)


def reverse(tree):
    """The tree of the mirrored language."""
    if tree[0] == "cat":
        return ("cat", [reverse(x) for x in reversed(tree[1])])
    if tree[0] == "alt":
        return ("alt", [reverse(x) for x in tree[1]])
    if tree[0] == "rep":
        return ("rep", reverse(tree[1]), *tree[2:])
    return tree


def thread(nfa: Nfa, tree, start: int) -> int:
    """Adds the tree after `start`; returns the state reached when it has matched."""
    if tree[0] == "set":
        end = nfa.state()
        nfa.moves[start].append((tree[1], end))
        return end
    if tree[0] == "cat":
        for item in tree[1]:
            start = thread(nfa, item, start)
        return start
    if tree[0] == "alt":
        end = nfa.state()
        for item in tree[1]:
            begin = nfa.state()
            nfa.empty[start].append(begin)
            nfa.empty[thread(nfa, item, begin)].append(end)
        return end
    _, item, least, most = tree
    for _ in range(least):
        start = thread(nfa, item, start)
    if most is None:
        hub = nfa.state()
        nfa.empty[start].append(hub)
        nfa.empty[thread(nfa, item, hub)].append(hub)
        return hub
    end = nfa.state()
    for _ in range(most - least):
        nfa.empty[start].append(end)
        start = thread(nfa, item, start)
    nfa.empty[start].append(end)
    return end


@dataclass(frozen=True)
class Dfa:
    """next[state * 256 + byte]: the next state times 256; accepts[state]: bit k set if rule k matches there.

    State 0 is the start; `dead` is the premultiplied state that nothing leaves, or -1. States that accept come last,
    from `accepting` (premultiplied) on, so that one comparison tells them apart.
    """

    next: list[int]
    accepts: list[int]
    accepting: int
    dead: int

    @property
    def n_states(self) -> int:
        return len(self.accepts)


def determinise(trees: list, floating: bool) -> Dfa:
    """One automaton for all trees. floating: a match may begin at any byte (the start state keeps itself alive)."""
    nfa = Nfa()
    root = nfa.state()
    if floating:
        nfa.moves[root].append((ALL, root))
    final: dict[int, int] = {}
    for k, tree in enumerate(trees):
        begin = nfa.state()
        nfa.empty[root].append(begin)
        end = thread(nfa, tree, begin)
        final[end] = final.get(end, 0) | 1 << k

    def closure(states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if nfa.moves[s] or s in final)

    # Bytes that every set treats alike form one class.
    sets = list({s for moves in nfa.moves for s, _ in moves})
    classes: dict[tuple[bool, ...], list[int]] = {}
    for b in range(256):
        classes.setdefault(tuple(b in s for s in sets), []).append(b)
    members = list(classes.values())
    by_class = [[(k, t) for s, t in moves for k, m in enumerate(members) if m[0] in s] for moves in nfa.moves]

    ids = {closure({root}): 0}
    order = list(ids)
    rows: list[list[int]] = []
    while len(rows) < len(order):
        targets: list[set[int]] = [set() for _ in members]
        for s in order[len(rows)]:
            for k, t in by_class[s]:
                targets[k].add(t)
        row = []
        for target in targets:
            group = closure(target)
            if group not in ids:
                ids[group] = len(order)
                order.append(group)
            row.append(ids[group])
        rows.append(row)
    accepts = []
    for group in order:
        bits = 0
        for s in group:
            bits |= final.get(s, 0)
        accepts.append(bits)
    return minimise(np.array(rows), np.array(accepts, dtype=object), members)


def minimise(moves: np.ndarray, accepts: np.ndarray, members: list[list[int]]) -> Dfa:
    """Refines the partition by what states accept until no byte class tells two states of a block apart."""
    _, block = np.unique(accepts.astype(str), return_inverse=True)
    count = 0
    while (now := int(block.max()) + 1) != count:
        count = now
        signature = np.column_stack([block, block[moves]])
        _, block = np.unique(signature, axis=0, return_inverse=True)
        block = block.ravel()
    first = {int(b): i for i, b in reversed(list(enumerate(block)))}
    order = sorted(first, key=lambda b: (b != block[0] and bool(accepts[first[b]]), b != block[0], first[b]))
    if accepts[0]:
        raise ValueError("a rule matches the empty string")
    number = {b: i for i, b in enumerate(order)}
    table = np.zeros((len(order), 256), dtype=np.int64)
    for b, i in number.items():
        for k, group in enumerate(members):
            table[i, group] = number[int(block[moves[first[b], k]])]
    bits = [int(accepts[first[b]]) for b in order]
    dead = [i for i in range(len(order)) if not bits[i] and (table[i] == i).all() and i]
    quiet = sum(not x for x in bits)
    return Dfa((table * 256).ravel().tolist(), bits, quiet * 256, dead[0] * 256 if dead else -1)
