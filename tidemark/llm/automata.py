"""Regular expressions to minimal deterministic automata over bytes, as transition arrays.

``Automaton.of`` builds one automaton for several rules: Thompson fragments
from the parsed expressions, subset construction over classes of equivalent
bytes, then partition refinement. ``searching=True`` starts every rule anew at
each byte, so that one pass finds where matches of any rule end. With
``backward=True`` it reads from right to left, and so finds where matches begin.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser as parser

import numpy as np

from tidemark.llm.flat import mix


class _Fragments:
    """Nondeterministic automaton: byte-set edges and empty edges."""

    def __init__(self, backward: bool = False) -> None:
        self.backward = backward
        self.edges: list[list[tuple[np.ndarray, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, tree, at: int, flags: int = 0) -> int:
        """Append what ``tree`` accepts after state ``at``; gives the state behind it."""
        for op, arg in reversed(list(tree)) if self.backward else tree:
            at = self._one(op, arg, at, flags)
        return at

    def _one(self, op, arg, at: int, flags: int) -> int:
        if op in (C.LITERAL, C.NOT_LITERAL, C.IN, C.ANY):
            to = self.state()
            self.edges[at].append((_bytes(op, arg, flags), to))
            return to
        if op is C.SUBPATTERN:
            _, plus, minus, inner = arg
            return self.add(inner, at, (flags | plus) & ~minus)
        if op is C.BRANCH:
            to = self.state()
            for inner in arg[1]:
                self.empty[self.add(inner, at, flags)].append(to)
            return to
        if op is C.MAX_REPEAT:
            least, most, inner = arg
            for _ in range(least):
                at = self.add(inner, at, flags)
            if most is C.MAXREPEAT:
                loop = self.state()
                self.empty[at].append(loop)
                self.empty[self.add(inner, loop, flags)].append(loop)
                return loop
            to = self.state()
            for _ in range(most - least):
                self.empty[at].append(to)
                at = self.add(inner, at, flags)
            self.empty[at].append(to)
            return to
        raise ValueError(f"rules may not use {op}")


def _bytes(op, arg, flags: int) -> np.ndarray:
    out = np.zeros(256, bool)
    if op is C.LITERAL or op is C.NOT_LITERAL:
        out[arg] = True
    elif op is C.IN:
        for kind, x in arg:
            if kind is C.LITERAL:
                out[x] = True
            elif kind is C.RANGE:
                out[x[0] : x[1] + 1] = True
            elif kind is not C.NEGATE:
                raise ValueError(f"rules may not use {kind}")
    if flags & re.IGNORECASE:
        for b in np.flatnonzero(out):
            out[list({ord(chr(b).lower()), ord(chr(b).upper())} if b < 128 else {b})] = True
    if op is C.ANY:
        out[:] = True
        out[10] = False
    return ~out if op is C.NOT_LITERAL or (op is C.IN and arg[0][0] is C.NEGATE) else out


class Automaton:
    """``table[state, class_of[byte]]`` is the next state, ``accepts[state]`` a bit per rule; state 0 starts.

    ``dead`` is the state without a way to accept, -1 if there is none.
    ``resets`` marks the bytes that lead from every state to the start: no match goes over them.
    """

    def __init__(self, class_of: np.ndarray, table: np.ndarray, accepts: np.ndarray):
        self.class_of, self.table, self.accepts = class_of, table, accepts
        still = (table == np.arange(len(table))[:, None]).all(axis=1) & (accepts == 0)
        self.dead = int(np.flatnonzero(still)[0]) if still.any() and len(table) > 1 else -1
        self.resets = (table == 0).all(axis=0)[class_of]

    @classmethod
    def of(cls, patterns: list[str], searching: bool, backward: bool = False) -> Automaton:
        nfa = _Fragments(backward)
        starts, ends = [], {}
        for k, pattern in enumerate(patterns):
            starts.append(at := nfa.state())
            ends[nfa.add(parser.parse(pattern.encode("ascii")), at)] = 1 << k
        closures = [_closure(nfa.empty, s) for s in range(len(nfa.edges))]
        sets = np.array([e for edges in nfa.edges for e, _ in edges])
        _, class_of = np.unique(sets, axis=1, return_inverse=True)
        class_of = class_of.reshape(-1).astype(np.uint8)
        sample = [int(np.flatnonzero(class_of == c)[0]) for c in range(class_of.max() + 1)]
        steps = [{c: frozenset().union(*(closures[to] for e, to in edges if e[b])) for c, b in enumerate(sample)} for edges in nfa.edges]
        first = frozenset().union(*(closures[s] for s in starts))
        names, rows, todo = {first: 0}, [], [first]
        while todo:
            now = todo.pop(0)
            row = []
            for c in range(len(sample)):
                to = set(first) if searching else set()
                for s in now:
                    to |= steps[s][c]
                to = frozenset(to)
                if to not in names:
                    names[to] = len(names)
                    todo.append(to)
                row.append(names[to])
            rows.append(row)
        accepts = np.array([sum({ends.get(s, 0) for s in now}) for now in names], np.int64)
        return cls(class_of, *_minimal(np.array(rows, np.int64), accepts))


def _closure(empty: list[list[int]], state: int) -> frozenset[int]:
    seen, todo = {state}, [state]
    while todo:
        for to in empty[todo.pop()]:
            if to not in seen:
                seen.add(to)
                todo.append(to)
    return frozenset(seen)


def _minimal(table: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Split classes of states until no byte tells two states of a class apart."""
    group = np.unique(accepts, return_inverse=True)[1]
    weights = mix(np.arange(1, table.shape[1] + 2, dtype=np.uint64)) | np.uint64(1)
    while True:
        views = np.column_stack([group, group[table]]).astype(np.uint64)
        finer = np.unique((mix(views + np.uint64(1)) * weights).sum(axis=1, dtype=np.uint64), return_inverse=True)[1]
        if finer.max() == group.max():
            break
        group = finer
    order = np.unique(group, return_index=True)[1]
    rank = np.argsort(np.argsort(order))  # the start state stays 0
    small = np.zeros((len(order), table.shape[1]), np.int64)
    kept = np.zeros(len(order), np.int64)
    for g, s in enumerate(order):
        small[rank[g]] = rank[group[table[s]]]
        kept[rank[g]] = accepts[s]
    return small, kept
