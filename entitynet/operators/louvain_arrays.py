"""The rounds of ``louvain`` over arrays, for a graph that one task holds.

Every function does what its namesake in ``louvain`` does for one trial, with the same order of floating
point operations and the same ties, so both find the same communities. Nodes are
places 0 to n - 1 in the order of their numbers; a community is named by a place.

In memory are some numbers for each node, and the rows that are worked on. The edges of a
larger graph lie in files without a name in the task's temporary folder, which go when they are closed.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np

#: Rows of the graph that are worked on at once, and that are sorted at once.
PIECE, SORTED = 500_000, 4_000_000
#: Nodes that are looked at for their rows at once, and proposals that are ordered at once.
BLOCK = 1_000_000
#: Bytes of an array beyond which it is a file.
HELD = 1 << 25


class Column:
    """Numbers that are appended and then read; many of them lie in a file."""

    def __init__(self, kind: type):
        self.kind, self.parts, self.size, self.file = np.dtype(kind), [], 0, None

    def append(self, part: np.ndarray) -> None:
        part = np.ascontiguousarray(part, self.kind)
        self.size += len(part)
        if self.file is None and self.size * self.kind.itemsize > HELD:
            self.file = tempfile.TemporaryFile()
            for before in self.parts:
                before.tofile(self.file)
            self.parts = []
        if self.file is None:
            self.parts.append(part.copy())
        else:
            part.tofile(self.file)

    def read(self) -> tuple[np.ndarray, list[mmap.mmap]]:
        """The numbers, and the map of their file."""
        if self.file is None:
            return np.concatenate([np.empty(0, self.kind), *self.parts]), []
        self.file.flush()
        pages = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)
        return np.frombuffer(pages, self.kind), [pages]


def unload(maps: list[mmap.mmap]) -> None:
    """Let go of the pages of files that have been read."""
    for pages in maps:
        pages.madvise(mmap.MADV_DONTNEED)


class Edges:
    """(src, dst, kind, value) as they come; ``kind`` is None where all are of kind 0."""

    def __init__(self, kinds: bool):
        self.columns = [Column(np.int32), Column(np.int32), *([Column(np.int8)] if kinds else []), Column(np.int64)]
        self.kinds = kinds

    def append(self, *parts: np.ndarray) -> None:
        for column, part in zip(self.columns, parts):
            column.append(part)

    def pieces(self) -> Iterator[tuple]:
        read = [column.read() for column in self.columns]
        for start in range(0, self.columns[0].size, PIECE):
            src, dst, *kind, value = (x[start:start + PIECE] for x, _ in read)
            yield src, dst, kind[0] if kind else None, value
            for _, maps in read:
                unload(maps)


def strengths(edges: Edges, n: int, factor: np.ndarray | None) -> np.ndarray:
    k = np.zeros(n, np.int64)
    for src, dst, kind, value in edges.pieces():
        weight = value if kind is None else value * factor[kind]
        np.add.at(k, src, weight)
        np.add.at(k, dst, weight)
    return k


@dataclass
class Graph:
    """Every edge both ways, by node and without loops: a node's rows lie between its place in ``ends`` and the next.

    A row's weight is its value, times its kind's ``factor`` where there are kinds.
    """

    ends: np.ndarray
    near: np.ndarray
    value: np.ndarray
    kind: np.ndarray | None = None
    factor: np.ndarray | None = None
    maps: list[mmap.mmap] = field(default_factory=list)

    def weight(self, row: np.ndarray | slice) -> np.ndarray:
        return self.value[row] if self.kind is None else self.value[row] * self.factor[self.kind[row]]

    def rows(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``nodes``, the place in ``nodes`` and in the graph."""
        number = self.ends[nodes + 1] - self.ends[nodes]
        of = np.repeat(np.arange(len(nodes)), number)
        return of, np.arange(len(of)) + np.repeat(self.ends[nodes] - np.cumsum(number) + number, number)

    def pieces(self, nodes: np.ndarray) -> Iterator[np.ndarray]:
        """``nodes`` that have rows, in parts of about ``PIECE`` rows."""
        for block in range(0, len(nodes), BLOCK):
            some = nodes[block:block + BLOCK]
            number = self.ends[some + 1] - self.ends[some]
            some, number = some[number > 0], np.cumsum(number[number > 0])
            if len(some):
                for part in np.split(some, np.unique(np.searchsorted(number, np.arange(PIECE, number[-1], PIECE)) + 1)):
                    if len(part):
                        yield part
                        unload(self.maps)


def ranges(number: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Places in turn that have about ``size`` rows together."""
    total = np.cumsum(number)
    cuts = np.searchsorted(total, np.arange(size, total[-1], size)) + 1 if len(total) else []
    bounds = np.unique([0, *cuts, len(number)]).tolist()
    yield from zip(bounds, bounds[1:])


def by_node(n: int, rows: Callable[[], Iterable[tuple]], kinds: bool, merged: bool) -> Graph:
    """The graph of the rows (node, near, kind, value) that each call of ``rows`` gives; with ``merged`` equal pairs are added."""
    number = np.zeros(n, np.int32)
    for node, *_ in rows():
        np.add.at(number, node, 1)
    near, kind, value, ends = Column(np.int32), Column(np.int8), Column(np.int64), np.zeros(n + 1, np.int64)
    for low, high in ranges(number, SORTED):
        parts = []
        for part in rows():
            mine = np.flatnonzero((part[0] >= low) & (part[0] < high))
            parts.append([None if x is None else x[mine] for x in part])
        if not parts:
            continue
        a, b, of, w = (None if x[0] is None else np.concatenate(x) for x in zip(*parts))
        del parts
        key = a.astype(np.int64) * n + b
        order = np.argsort(key)
        if merged:
            first = np.flatnonzero(starts(key[order]))
            w = np.add.reduceat(w[order], first) if len(first) else w
            order = order[first]
        else:
            w = w[order]
        near.append(b[order])
        value.append(w)
        if kinds:
            kind.append(of[order])
        ends[low + 1:high + 1] = np.bincount(a[order] - low, minlength=high - low)
    np.cumsum(ends, out=ends)
    (near, one), (value, two), (kind, three) = near.read(), value.read(), kind.read()
    return Graph(ends, near, value, kind if kinds else None, maps=[*one, *two, *three])


def graph(edges: Edges, n: int, merged: bool = False) -> Graph:
    """The graph of ``edges``; with ``merged`` equal ones are added."""
    def rows() -> Iterator[tuple]:
        for src, dst, kind, value in edges.pieces():
            apart = src != dst
            src, dst, kind, value = src[apart], dst[apart], None if kind is None else kind[apart], value[apart]
            yield src, dst, kind, value
            yield dst, src, kind, value

    return by_node(n, rows, edges.kinds, merged)


@dataclass
class State:
    """The community of each node; strength and number of nodes of each community."""

    com: np.ndarray
    total: np.ndarray
    size: np.ndarray


def placed(com: np.ndarray, k: np.ndarray, there: np.ndarray) -> State:
    """The state of the nodes that are ``there``."""
    total = np.zeros(len(com), np.int64)
    np.add.at(total, com, k)
    return State(com, total, np.bincount(com[there], minlength=len(com)).astype(np.int32))


def starts(*sorted_by: np.ndarray) -> np.ndarray:
    """True where a run of equal values begins."""
    new = np.zeros(len(sorted_by[0]), bool)
    new[:1] = True
    for x in sorted_by:
        new[1:] |= x[1:] != x[:-1]
    return new


def best_moves(g: Graph, at: State, k: np.ndarray, pull: float, active: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, to, gain) of the active nodes that gain."""
    n, found = len(k), [Column(np.int32), Column(np.int32), Column(float)]
    for nodes in g.pieces(active):
        of, row = g.rows(nodes)
        key = of * n + at.com[g.near[row]]
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(starts(key))
        kin = np.add.reduceat(g.weight(row[order]), first)
        v, c = np.divmod(key[first], n)
        own, mine = at.com[nodes], k[nodes]
        each = pull * mine.astype(float)
        here = c == own[v]
        kin_here = np.zeros(len(nodes), np.int64)
        kin_here[v[here]] = kin[here]
        stays = kin_here.astype(float) - each * (at.total[own] - mine).astype(float)
        allowed = ~here & ((at.size[c] > 1) | (at.size[own] > 1)[v] | (c < own[v]))
        v, c, kin = v[allowed], c[allowed], kin[allowed]
        if not len(v):
            continue
        worth = kin.astype(float) - each[v] * at.total[c].astype(float)
        new = starts(v)
        top = np.maximum.reduceat(worth, np.flatnonzero(new))
        # Candidates stand by community, so the first of equal ones is the smallest.
        best = np.flatnonzero(worth == top[np.cumsum(new) - 1])
        best = best[starts(v[best])]
        gain = worth[best] - stays[v[best]]
        goes = gain > least * mine[v[best]].astype(float)
        for column, part in zip(found, (nodes[v[best[goes]]], c[best[goes]], gain[goes])):
            column.append(part)
    return tuple(column.read()[0] for column in found)


def compatible(g: Graph, at: State, k: np.ndarray, pull: float, node: np.ndarray, to: np.ndarray, gain: np.ndarray, steps: int) -> np.ndarray:
    """Which of the proposals go ahead together."""
    own, mine = at.com[node], k[node]
    strength = gain / mine.astype(float)
    step = np.floor(np.log(strength) / np.log(2.0) * steps).astype(np.int64)

    others, leads = -2 * mine, np.ones(len(node), bool)

    def met(side: np.ndarray) -> None:
        """Add the strength of the proposals of at least each one's step at the same community; the strongest of all there leads."""
        for low, high in ranges(np.bincount(side, minlength=len(k)), BLOCK):
            here = np.flatnonzero((side >= low) & (side < high))
            at, k_, step_ = side[here], mine[here], step[here]
            order = np.lexsort((-step_, at))
            new, block = starts(at[order]), starts(at[order], step_[order])
            run = np.cumsum(k_[order])
            before = (run - k_[order])[new][np.cumsum(new) - 1]
            others[here[order]] += run[np.r_[np.flatnonzero(block)[1:], len(run)] - 1][np.cumsum(block) - 1] - before
            order = np.lexsort((node[here], -strength[here], at))
            leads[here[order[~starts(at[order])]]] = False

    place = np.full(len(k), -1, np.int32)
    place[node] = np.arange(len(node))
    lost, clashes = np.zeros(len(node), np.int64), np.zeros(len(node), bool)
    for nodes in g.pieces(node):
        of, row = g.rows(nodes)
        x, y = place[nodes][of], place[g.near[row]]
        one = (y >= 0) & (nodes[of] < g.near[row])
        x, y, weight = x[one], y[one], g.weight(row[one])
        left, entered = own[y] == to[x], to[y] == own[x]
        clash = left | entered
        x, y, weight = x[clash], y[clash], (weight * np.where(left & entered, 2, 1))[clash]
        weaker = np.where(strength[y] > strength[x], x, y)
        np.add.at(lost, weaker, weight)
        clashes[weaker] = True
    met(own)
    met(to)
    return (gain > pull * others.astype(float) * mine.astype(float) + lost.astype(float)) | (~clashes & leads)


def settle(g: Graph, at: State, k: np.ndarray, gamma: float, pull: float, patience: float, again: bool, every: np.ndarray, least: float, steps: int) -> bool:
    """Rounds until no active node gains; the state is changed in place. True if any node moved."""
    changed, complete, active = False, True, every
    while True:
        node, to, gain = best_moves(g, at, k, pull, active, least)
        goes = compatible(g, at, k, pull, node, to, gain, steps) if len(node) else np.empty(0, bool)
        if goes.any():
            changed, complete = True, False
            moved, into = node[goes], to[goes]
            own, mine = at.com[moved], k[moved]
            np.subtract.at(at.total, own, mine)
            np.add.at(at.total, into, mine)
            np.subtract.at(at.size, own, 1)
            np.add.at(at.size, into, 1)
            at.com[moved] = into
            if int(np.floor(gain[goes]).astype(np.int64).sum()) * pull < patience * gamma:
                return changed
            woken = np.zeros(len(k), bool)
            woken[node] = True
            for nodes in g.pieces(moved):
                woken[g.near[g.rows(nodes)[1]]] = True
            active = np.flatnonzero(woken).astype(np.int32)
        elif again and not complete:
            complete, active = True, every
        else:
            return changed


def between(g: Graph, com: np.ndarray, n: int) -> Graph:
    """The graph whose nodes are the communities 0 to n - 1."""
    cross = Edges(False)
    for nodes in g.pieces(np.arange(len(g.ends) - 1, dtype=np.int32)):
        of, row = g.rows(nodes)
        a, b = com[nodes][of], com[g.near[row]]
        up = np.flatnonzero(a < b)
        key = a[up].astype(np.int64) * n + b[up]
        order = np.argsort(key)
        key, first = key[order], np.flatnonzero(starts(key[order]))
        if len(first):
            cross.append(*np.divmod(key[first], n), np.add.reduceat(g.weight(row[up[order]]), first))
    return graph(cross, n, True)


def climb(g: Graph, at: State, gamma: float, pull: float, patience: float, small: int, to_the_top: Callable, least: float,
          steps: int) -> tuple[np.ndarray, bool]:
    """Communities become nodes, again and again: the new community of each place, and whether some merged."""
    top = np.arange(len(at.com), dtype=np.int32)
    own = now = np.flatnonzero(at.size).astype(np.int32)
    names, merged = top, False
    while True:
        kept = np.flatnonzero(at.size)
        place = np.zeros(len(at.size), np.int32)
        place[kept] = np.arange(len(kept))
        g = between(g, place[at.com], len(kept))
        names, now, k = names[kept], place[now], at.total[kept]
        if len(g.near) <= small:
            step = to_the_top(g, k, pull)
            top[own] = names[step[now]]
            return top, merged or bool((step != np.arange(len(kept))).any())
        at = State(np.arange(len(kept), dtype=np.int32), k.copy(), np.ones(len(kept), np.int32))
        changed = settle(g, at, k, gamma, pull, patience, False, np.arange(len(kept), dtype=np.int32), least, steps)
        now = at.com[now]
        if not changed:
            top[own] = names[now]
            return top, merged
        merged = True


def trial(g: Graph, com: np.ndarray, k: np.ndarray, there: np.ndarray, gamma: float, pull: float, patience: float, small: int,
          to_the_top: Callable, least: float, steps: int) -> np.ndarray:
    """The communities of one trial from the start ``com``; ``there`` marks the nodes of the graph."""
    at, every = placed(com, k, there), np.flatnonzero(there).astype(np.int32)
    settled = not settle(g, at, k, gamma, pull, patience, False, every, least, steps)
    while True:
        top, merged = climb(g, at, gamma, pull, patience, small, to_the_top, least, steps)
        at = placed(top[at.com], k, there)
        if settled and not merged:
            return at.com
        settle(g, at, k, gamma, pull, 0.0, True, every, least, steps)
        settled, patience = True, 0.0
