"""Regular expressions as deterministic automata: subset construction, minimisation, transition lists."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass


class Nfa:
    """States with byte edges and empty edges; rules are built from combinators, not parsed."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def closure(self, states: Iterable[int]) -> frozenset[int]:
        seen = set(states)
        stack = list(seen)
        while stack:
            for following in self.empty[stack.pop()]:
                if following not in seen:
                    seen.add(following)
                    stack.append(following)
        return frozenset(seen)


@dataclass(frozen=True)
class Pattern:
    """``kind`` is set, seq, alt, star or opt; ``parts`` are bytes or patterns."""

    kind: str
    parts: tuple

    def build(self, nfa: Nfa, start: int, end: int) -> None:
        if self.kind == "set":
            nfa.edges[start].append((frozenset(self.parts), end))
        elif self.kind == "seq":
            at = start
            for part in self.parts:
                following = nfa.state()
                part.build(nfa, at, following)
                at = following
            nfa.empty[at].append(end)
        elif self.kind == "alt":
            for part in self.parts:
                part.build(nfa, start, end)
        else:
            inner, after = nfa.state(), nfa.state()
            nfa.empty[start] += [inner, end]
            self.parts[0].build(nfa, inner, after)
            nfa.empty[after] += [inner, end] if self.kind == "star" else [end]

    def reversed(self) -> Pattern:
        if self.kind == "set":
            return self
        parts = tuple(p.reversed() for p in self.parts)
        return Pattern(self.kind, parts[::-1] if self.kind == "seq" else parts)


def chars(allowed: str) -> Pattern:
    return Pattern("set", tuple(sorted(set(allowed.encode()))))


def word(text: str, any_case: bool = False) -> Pattern:
    return seq(*(chars(c.lower() + c.upper() if any_case else c) for c in text))


def seq(*parts: Pattern) -> Pattern:
    return Pattern("seq", parts)


def alt(*parts: Pattern) -> Pattern:
    return Pattern("alt", parts)


def star(part: Pattern) -> Pattern:
    return Pattern("star", (part,))


def opt(part: Pattern) -> Pattern:
    return Pattern("opt", (part,))


def plus(part: Pattern) -> Pattern:
    return seq(part, star(part))


def at_least(part: Pattern, n: int) -> Pattern:
    return seq(*[part] * n, star(part))


def compile_all(patterns: list[Pattern], anywhere: bool) -> list[list]:
    """One minimal automaton for all patterns, as linked rows.

    A row has the following row for each of 256 bytes, then a bit mask of the patterns that end here.
    The first row is the start. ``anywhere`` lets a match begin at any byte. Rows that lead nowhere are
    one dead row whose last entry is -1.
    """
    nfa = Nfa()
    start = nfa.state()
    ends = {}
    for i, pattern in enumerate(patterns):
        end = nfa.state()
        ends[end] = 1 << i
        pattern.build(nfa, start, end)
    begin = nfa.closure([start])
    ids, queue, table, marks = {begin: 0}, [begin], [], []
    for states in queue:  # grows while it is read
        following: list[set[int]] = [set() for _ in range(256)]
        for state in states:
            for allowed, to in nfa.edges[state]:
                for byte in allowed:
                    following[byte].add(to)
        row, cache = [], {}
        for to in following:
            to = frozenset(to)
            if to not in cache:
                key = nfa.closure(to) | (begin if anywhere else frozenset())
                if key not in ids:
                    ids[key] = len(ids)
                    queue.append(key)
                cache[to] = ids[key]
            row.append(cache[to])
        table.append(row)
        marks.append(sum({ends[s] for s in states if s in ends}))
    return _linked(*_minimal(table, marks))


def _minimal(table: list[list[int]], marks: list[int]) -> tuple[list[list[int]], list[int]]:
    """Merge states that no input tells apart, by refining blocks until they are stable."""
    block = [0] * len(table)
    names: dict = {}
    for i, mark in enumerate(marks):
        block[i] = names.setdefault(mark, len(names))
    while True:
        names = {}
        refined = [
            names.setdefault((block[i], tuple(block[to] for to in row)), len(names)) for i, row in enumerate(table)
        ]
        if len(names) == len(set(block)):
            break
        block = refined
    order = {b: i for i, b in enumerate(dict.fromkeys(block))}  # the start keeps number 0
    small: list[list[int]] = [[] for _ in order]
    mark_of = [0] * len(order)
    for i, row in enumerate(table):
        at = order[block[i]]
        if not small[at]:
            small[at] = [order[block[to]] for to in row]
            mark_of[at] = marks[i]
    return small, mark_of


def _linked(table: list[list[int]], marks: list[int]) -> list[list]:
    rows: list[list] = [[None] * 257 for _ in table]
    for i, row in enumerate(table):
        rows[i][:256] = [rows[to] for to in row]
        dead = not marks[i] and all(to == i for to in row)
        rows[i][256] = -1 if dead else marks[i]
    return rows
