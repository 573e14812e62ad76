"""Byte automata: rule regexes to one minimal deterministic automaton in transition arrays."""

from __future__ import annotations

import re
import re._constants as op
import re._parser as sre
from collections import deque
from dataclasses import dataclass

import numpy as np

LETTERS = frozenset(range(65, 91)) | frozenset(range(97, 123))


@dataclass(frozen=True)
class Automaton:
    """`step[state * classes + byte_class[byte]]` is the next state, already multiplied by `classes`.

    Accepting states come last (from `accept_from` on); `rules[state]` has a bit for each rule that has
    just matched.  After a `reset` byte the automaton is in its start state whatever came before.
    """

    step: np.ndarray
    byte_class: np.ndarray
    classes: int
    start: int
    accept_from: int
    rules: np.ndarray
    reset: np.ndarray


class _Nfa:
    """Thompson construction; a state has byte-set edges and empty edges."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, items, at: int, fold: bool) -> int:
        for kind, arg in items:
            at = self._item(kind, arg, at, fold)
        return at

    def _item(self, kind, arg, at: int, fold: bool) -> int:
        if kind is op.SUBPATTERN:
            return self.add(arg[3], at, (fold or bool(arg[1] & re.I)) and not arg[2] & re.I)
        if kind is op.BRANCH:
            end = self.state()
            for branch in arg[1]:
                self.empty[self.add(branch, at, fold)].append(end)
            return end
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, body = arg
            for _ in range(low):
                at = self.add(body, at, fold)
            end = self.state()
            self.empty[at].append(end)
            if high is op.MAXREPEAT:
                self.empty[self.add(body, end, fold)].append(end)
            else:
                for _ in range(high - low):
                    at = self.add(body, at, fold)
                    self.empty[at].append(end)
            return end
        to = self.state()
        self.edges[at].append((_bytes(kind, arg, fold), to))
        return to


def _bytes(kind, arg, fold: bool) -> frozenset[int]:
    if kind is op.LITERAL:
        found = {arg}
    elif kind is op.NOT_LITERAL:
        found = set(range(256)) - {arg}
    elif kind is op.ANY:
        found = set(range(256)) - {10}
    elif kind is op.IN:
        found = set()
        for k, a in arg:
            if k is op.RANGE:
                found |= set(range(a[0], a[1] + 1))
            elif k is op.LITERAL:
                found.add(a)
            elif k is not op.NEGATE:
                raise ValueError(f"unsupported in a class: {k}")
        if arg[0][0] is op.NEGATE:
            found = set(range(256)) - found
    else:
        raise ValueError(f"unsupported in a rule: {kind}")
    if fold:
        found |= {b ^ 32 for b in found if b in LETTERS}
    return frozenset(found)


def compile_rules(patterns: list[bytes]) -> Automaton:
    """One automaton that finds any of the patterns anywhere in a byte string.

    Subset construction over the union of the rules' automata, entered anew at every byte, then
    minimisation by refining partitions.  Anchors, look-around and back-references are refused.
    """
    nfa = _Nfa()
    root = nfa.state()
    accept: dict[int, int] = {}
    for rule, pattern in enumerate(patterns):
        parsed = sre.parse(pattern)
        accept[nfa.add(parsed, root, bool(parsed.state.flags & re.I))] = 1 << rule

    # bytes that no rule tells apart share a class
    signature: dict[int, list[int]] = {b: [] for b in range(256)}
    sets = {e[0] for edges in nfa.edges for e in edges}
    for i, members in enumerate(sets):
        for b in members:
            signature[b].append(i)
    classes: dict[tuple, int] = {}
    byte_class = np.array([classes.setdefault(tuple(signature[b]), len(classes)) for b in range(256)], np.uint8)
    sample = {int(c): b for b, c in reversed(list(enumerate(byte_class)))}
    n_classes = len(classes)

    def close(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for to in nfa.empty[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(s for s in seen if nfa.edges[s] or s in accept)

    base = close([root])
    moves = [{c: [to for members, to in edges if sample[c] in members] for c in range(n_classes)} for edges in nfa.edges]
    number = {base: 0}
    table: list[list[int]] = []
    marks: list[int] = []
    todo = deque([base])
    while todo:
        now = todo.popleft()
        row = []
        for c in range(n_classes):
            to = close({t for s in now for t in moves[s][c]}) | base
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        table.append(row)
        mark = 0
        for s in now:
            mark |= accept.get(s, 0)
        marks.append(mark)

    # minimise: split blocks by their marks, then by the blocks that each class leads to
    moves_to, block = np.array(table), np.unique(marks, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[moves_to]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    first = np.unique(block, return_index=True)[1]
    mark_of = np.array(marks)[first]
    order = np.argsort(mark_of > 0, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    small = rank[block[moves_to[first]]][order]
    start = int(rank[block[0]])
    resets = np.array([bool((small[:, c] == start).all()) for c in range(n_classes)])
    return Automaton((small * n_classes).astype(np.int32).ravel(), byte_class, n_classes, start * n_classes, int((mark_of == 0).sum()) * n_classes, mark_of[order].astype(np.int64), resets[byte_class])


def lanes(data: np.ndarray, offsets: np.ndarray, auto: Automaton, width: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pieces of about `width` bytes, cut at row borders and after reset bytes only.

    No match can cross such a cut, so that pieces are scanned independently.
    """
    low, high = int(offsets[0]), int(offsets[-1])
    cuts = np.flatnonzero(auto.reset[data[low:high]]) + low + 1
    if len(cuts):
        bucket = cuts // width
        cuts = cuts[np.concatenate([[True], bucket[1:] != bucket[:-1]])]
    edges = np.unique(np.concatenate([cuts, offsets]))
    return edges[:-1], edges[1:]


def scan(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, auto: Automaton, block: int = 1 << 14) -> np.ndarray:
    """Bit mask of the rules that match in each piece: one pass over the bytes, many pieces in lockstep."""
    found = np.zeros(len(starts), np.int64)
    by_length = np.argsort(starts - ends, kind="stable")
    for at in range(0, len(by_length), block):
        own = by_length[at : at + block]
        position = starts[own].copy()
        lengths = (ends - starts)[own]
        state = np.full(len(own), auto.start, np.int64)
        hits = np.zeros(len(own), np.int64)
        alive = len(own) - np.searchsorted(lengths[::-1], np.arange(1, lengths[0] + 1 if len(lengths) else 1), side="left")
        for n in alive:
            if n < len(state):
                position, state = position[:n], state[:n]
            state = auto.step.take(state + auto.byte_class.take(data.take(position)))
            position = position + 1
            if state.max() >= auto.accept_from:
                hit = np.flatnonzero(state >= auto.accept_from)
                hits[hit] |= auto.rules[state[hit] // auto.classes]
        found[own] = hits
    return found
