"""Patterns of many rules compiled to one deterministic automaton over bytes, and its scan.

A rule is a head and a tail of one repeated class. Each pattern becomes a graph of
byte sets; subset construction over all rules at once and minimisation turn them into
transition arrays. A state of the construction keeps a rule's open attempts in the order
of their first bytes, so that the automaton itself follows the first match to its longest
end and starts afresh behind it. Compiling fails for a rule whose leftmost match one pass
cannot know.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

#: A byte that no UTF-8 text holds: it parts texts, and no rule passes it.
PART = 0xFF
#: A scan steps through this many places of a block at a time, one byte each.
STEPS, LANES = 128, 2048


class Graph:
    """A pattern of literals, escapes, classes, groups, `|`, `?`, `*` and `+` as states with byte sets on their edges."""

    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []
        self.start, self.end = self._choice()
        if self.at < len(pattern):
            raise ValueError(f"unbalanced pattern: {pattern}")

    def _state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def _choice(self) -> tuple[int, int]:
        start, end = self._state(), self._state()
        while True:
            first, last = self._sequence()
            self.free[start].append(first)
            self.free[last].append(end)
            if self._peek() != "|":
                return start, end
            self.at += 1

    def _peek(self) -> str:
        return self.pattern[self.at : self.at + 1]

    def _sequence(self) -> tuple[int, int]:
        start = last = self._state()
        while self._peek() not in ("", "|", ")"):
            first, end = self._atom()
            while self._peek() and self._peek() in "?*+":
                sign, before, after = self._peek(), self._state(), self._state()
                self.free[before].append(first)
                self.free[end].append(after)
                if sign != "+":
                    self.free[before].append(after)
                if sign != "?":
                    self.free[end].append(first)
                first, end = before, after
                self.at += 1
            self.free[last].append(first)
            last = end
        return start, last

    def _atom(self) -> tuple[int, int]:
        if self._peek() == "(":
            self.at += 1
            found = self._choice()
            self.at += 1
            return found
        start, end = self._state(), self._state()
        self.edges[start].append((self._bytes(), end))
        return start, end

    def _byte(self) -> int:
        c = self._peek()
        self.at += 1
        if c == "\\":
            if self._peek() == "x":
                self.at += 3
                return int(self.pattern[self.at - 2 : self.at], 16)
            c = self._peek()
            self.at += 1
        if not c or not c.isascii():
            raise ValueError(f"rules are ASCII: {self.pattern}")
        return ord(c)

    def _bytes(self) -> frozenset[int]:
        if self._peek() != "[":
            return frozenset([self._byte()])
        self.at += 1
        found: set[int] = set()
        while self._peek() != "]":
            low = high = self._byte()
            if self._peek() == "-" and self.pattern[self.at + 1 : self.at + 2] != "]":
                self.at += 1
                high = self._byte()
            found.update(range(low, high + 1))
        self.at += 1
        return frozenset(found)

    def reach(self, states) -> frozenset[int]:
        """The states and all that free edges lead to."""
        found, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in found:
                    found.add(t)
                    todo.append(t)
        return frozenset(found)

    def move(self, states, byte: int) -> frozenset[int]:
        return self.reach({t for s in states for allowed, t in self.edges[s] if byte in allowed})

    def backwards(self) -> Graph:
        """The graph that reads the same strings from their ends."""
        other = object.__new__(Graph)
        other.pattern, other.start, other.end = self.pattern, self.end, self.start
        other.edges, other.free = [[] for _ in self.edges], [[] for _ in self.free]
        for s, edges in enumerate(self.edges):
            for allowed, t in edges:
                other.edges[t].append((allowed, s))
            for t in self.free[s]:
                other.free[t].append(s)
        return other


def _advance(graph: Graph, leftmost: bool, attempts: tuple[frozenset[int], ...], byte: int) -> tuple[frozenset[int], ...]:
    """A rule's open attempts, leftmost first, after one more byte.

    An attempt in a state that an earlier one holds can add nothing. The attempt that
    matches first wins, of several the leftmost; with `leftmost`, no attempt that began
    before it may still be open, so that it is the match a regex search gives.
    """
    matched = bool(attempts) and graph.end in attempts[0]
    moved: list[frozenset[int]] = []
    held: frozenset[int] = frozenset()
    for attempt in attempts:
        if new := graph.move(attempt, byte) - held:
            moved.append(new)
            held |= new
    if matched and moved:
        if graph.end not in moved[0]:
            raise ValueError(f"a match must grow byte by byte: {graph.pattern}")
        return (moved[0],)
    if new := graph.move(graph.reach([graph.start]), byte) - held:
        moved.append(new)
    done = [k for k, attempt in enumerate(moved) if graph.end in attempt]
    if done and (leftmost and done[0] or matched):
        raise ValueError(f"the leftmost match must be the first to be seen: {graph.pattern}")
    return (moved[done[0]],) if done else tuple(moved)


class Automaton(NamedTuple):
    """Transition arrays: table[state + kind[byte]] is the next state, states being multiples of the number of kinds; matched[state] has bit r where rule r has a match."""

    table: np.ndarray
    kind: np.ndarray
    matched: np.ndarray

    @property
    def size(self) -> int:
        return len(self.table) // (int(self.kind.max()) + 1)


def _byte_kinds(graphs: list[Graph]) -> np.ndarray:
    """Bytes that no rule tells apart share a kind."""
    sets = sorted({tuple(sorted(allowed)) for g in graphs for edges in g.edges for allowed, _ in edges})
    member = np.zeros((256, len(sets) + 1), dtype=bool)
    for k, allowed in enumerate(sets):
        member[list(allowed), k] = True
    member[PART, -1] = True
    return np.unique(member, axis=0, return_inverse=True)[1].reshape(-1)


def _minimised(table: np.ndarray, matched: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States that no continuation tells apart become one: classes are split until none splits further. State 0 stays the first."""
    of = np.unique(matched, return_inverse=True)[1].reshape(-1)
    while True:
        rows = np.column_stack([of, of[table]])
        _, first, new = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        new = new.reshape(-1)
        if new.max() == of.max():
            break
        of = new
    order = np.argsort(first)  # classes by their first state, so the start comes first
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return place[new[table[first[order]]]], matched[first[order]]


def compile_rules(patterns: list[str], leftmost: int | None = None) -> Automaton:
    """One automaton for all patterns: subset construction from the state without open attempts, then minimisation. The first `leftmost` patterns (all, if None) must match as a regex search does."""
    graphs = [Graph(p) for p in patterns]
    kind = _byte_kinds(graphs)
    sample = [int(np.flatnonzero(kind == k)[0]) for k in range(int(kind.max()) + 1)]
    known: dict[tuple, tuple] = {}

    def advance(rule, attempts, byte):
        key = rule, attempts, byte
        if key not in known:
            known[key] = _advance(graphs[rule], leftmost is None or rule < leftmost, attempts, byte)
        return known[key]

    states = [tuple(() for _ in graphs)]
    number = {states[0]: 0}
    rows: list[list[int]] = []
    for state in states:  # grows as states are found
        row = []
        for byte in sample:
            new = tuple(advance(r, attempts, byte) for r, attempts in enumerate(state))
            if new not in number:
                number[new] = len(states)
                states.append(new)
            row.append(number[new])
        rows.append(row)
    hit = np.array([sum(1 << r for r, a in enumerate(state) if a and graphs[r].end in a[0]) for state in states], dtype=np.int64)
    table, hit = _minimised(np.array(rows), hit)
    width = len(sample)
    matched = np.zeros(len(table) * width, dtype=np.int32)
    matched[::width] = hit
    return Automaton((table * width).astype(np.int32).reshape(-1), kind.astype(np.int32), matched)


def _states(automaton: Automaton, steps: list[int], kinds: np.ndarray, state: int) -> np.ndarray:
    """The state after each byte of a block.

    The block is cut into lanes that step together, each from the start state. Then each
    lane is read again from the state that the one before it ends in, until it is in the
    state already written there, which is nearly always after a byte or two.
    """
    n = len(kinds)
    lanes = -(-n // STEPS)
    padded = np.zeros(lanes * STEPS, dtype=np.int32)
    padded[:n] = kinds
    columns = np.ascontiguousarray(padded.reshape(lanes, STEPS).T)
    out = np.empty((STEPS, lanes), dtype=np.int32)
    now = np.zeros(lanes, dtype=np.int32)
    for k in range(STEPS):
        np.take(automaton.table, now + columns[k], out=out[k])
        now = out[k]
    flat = np.ascontiguousarray(out.T).reshape(-1)
    for at in range(0, n, STEPS):
        end = min(at + STEPS, n)
        if state:
            for k in range(at, end):
                state = steps[state + int(padded[k])]
                if state == flat[k]:
                    break
                flat[k] = state
        state = int(flat[end - 1])
    return flat[:n]


def runs(automaton: Automaton, steps: list[int], data: np.ndarray, least: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(rule, floor, seen, end) of the matches in bytes that end with PART, of which at least least[rule] bytes were seen as matched.

    A match is seen from its byte `seen` on, which ends the shortest match from its first
    byte, and ends before `end`; that first byte is at `floor` or later, where the rule's
    match before it ended. `steps` is the table as a list. Memory beside the bytes is that
    of a block and of the matches.
    """
    block, rules = STEPS * LANES, len(least)
    opened, ended, state = [-1] * rules, [0] * rules, 0
    for base in range(0, len(data), block):
        states = _states(automaton, steps, automaton.kind[data[base : base + block]], state)
        state = int(states[-1])
        now = automaton.matched[states]
        at = np.flatnonzero(now)
        now = now[at]
        for r in range(rules):
            own = at[(now >> r) & 1 == 1] + base
            if not len(own) and opened[r] < 0:
                continue
            gaps = np.flatnonzero(np.diff(own) > 1)
            seen, end = own[np.append(0, gaps + 1)[: len(own)]], own[np.append(gaps, len(own) - 1)[: len(own)]] + 1
            if opened[r] >= 0 and len(own) and own[0] == base:
                seen[0] = opened[r]
            elif opened[r] >= 0:
                seen, end = np.append(opened[r], seen), np.append(base, end)
            going = len(own) and own[-1] == base + len(states) - 1
            opened[r] = int(seen[-1]) if going else -1
            if going:
                seen, end = seen[:-1], end[:-1]
            if len(end):
                floor = np.append(ended[r], end[:-1])
                ended[r] = int(end[-1])
                long = end - seen >= least[r]
                if long.any():
                    yield r, floor[long], seen[long], end[long]


class Reader:
    """Finds the first byte of a match by reading a pattern backwards."""

    def __init__(self, pattern: str):
        self.graph = Graph(pattern).backwards()
        self.known: dict[tuple[frozenset[int], int], frozenset[int]] = {}

    def first(self, data: np.ndarray, floor: int, seen: int) -> int:
        """The leftmost place at or after floor from which data up to `seen` is a match."""
        states, at, found = self.graph.reach([self.graph.start]), seen, -1
        while at >= floor:
            key = states, int(data[at])
            if key not in self.known:
                self.known[key] = self.graph.move(*key)
            states = self.known[key]
            if not states:
                break
            if self.graph.end in states:
                found = at
            at -= 1
        return found
