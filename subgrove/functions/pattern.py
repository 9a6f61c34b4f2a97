"""Patterns: small connected labelled graphs, held on the driver."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property


@dataclass(frozen=True)
class Pattern:
    """labels[i] is node i's label; edges are (u, v, label) with u < v, at most one a pair."""

    labels: tuple[float, ...]
    edges: tuple[tuple[int, int, float], ...]

    @staticmethod
    def of(labels, edges) -> Pattern:
        seen = {}
        for u, v, label in edges:
            if u == v:
                raise ValueError("a pattern has no self-loops")
            seen.setdefault((min(u, v), max(u, v)), float(label))
        return Pattern(tuple(map(float, labels)), tuple(sorted((u, v, x) for (u, v), x in seen.items())))

    @staticmethod
    def from_lg(text: str) -> Pattern:
        """From .lg text; node ids may be any numbers."""
        number, labels, edges = {}, [], []
        for line in text.split("\n"):
            kind, *rest = line.split() or [""]
            if kind == "v":
                if int(rest[0]) not in number:
                    number[int(rest[0])] = len(labels)
                    labels.append(float(rest[1]))
            elif kind == "e":
                edges.append((number[int(rest[0])], number[int(rest[1])], float(rest[2])))
        return Pattern.of(labels, edges)

    def to_lg(self) -> str:
        rows = ["# t 1", *(f"v {i} {x!r}" for i, x in enumerate(self.labels)), *(f"e {u} {v} {x!r}" for u, v, x in self.edges)]
        return "\n".join(rows) + "\n"

    @cached_property
    def around(self) -> dict[int, dict[int, float]]:
        out = defaultdict(dict)
        for u, v, x in self.edges:
            out[u][v] = out[v][u] = x
        return out

    @property
    def n_nodes(self) -> int:
        return len(self.labels)

    @property
    def n_edges(self) -> int:
        return len(self.edges)

    @property
    def kinds(self) -> frozenset[tuple[float, float, float]]:
        """The kinds of its edges (label, edge label, label at the other end), both ways round."""
        return frozenset((self.labels[i], x, self.labels[j]) for i, around in self.around.items() for j, x in around.items())

    def connected(self) -> bool:
        if not self.labels:
            return False
        seen, todo = {0}, [0]
        while todo:
            for v in self.around[todo.pop()]:
                if v not in seen:
                    seen.add(v)
                    todo.append(v)
        return len(seen) == self.n_nodes

    def acyclic(self) -> bool:
        return self.connected() and self.n_edges == self.n_nodes - 1

    def unique_labels(self) -> bool:
        return len(set(self.labels)) == self.n_nodes

    def held_by(self, counts: dict[float, int]) -> bool:
        """Whether there are as many vertices of each label as nodes."""
        return all(counts.get(x, 0) >= n for x, n in Counter(self.labels).items())

    def _refined(self, names: list) -> list[int]:
        """Classes of nodes that names and neighbourhoods don't tell apart, refined until they stand; numbered in a canonical order."""
        while True:
            rank = {c: k for k, c in enumerate(sorted(set(names)))}
            colours = [rank[c] for c in names]
            finer = [(colours[i], tuple(sorted((colours[j], x) for j, x in self.around[i].items()))) for i in range(self.n_nodes)]
            if len(set(finer)) == len(rank):
                return colours
            names = finer

    def _twins(self, i: int, j: int) -> bool:
        """Whether nodes of one class can be swapped and nothing changes."""
        mine, other = self.around[i], self.around[j]
        return all(mine.get(k) == other.get(k) for k in {*mine, *other} - {i, j})

    def _orders(self, colours: list[int]) -> Iterator[list[int]]:
        """Orders of the nodes by class. Where a class has several nodes, each in turn is set before the others and
        the classes are refined anew; of nodes that can be swapped one is tried."""
        sizes = Counter(colours)
        open_ = [c for c in sorted(sizes) if sizes[c] > 1]
        if not open_:
            yield sorted(range(self.n_nodes), key=colours.__getitem__)
            return
        tried: list[int] = []
        for i in (i for i, c in enumerate(colours) if c == open_[0]):
            if not any(self._twins(i, j) for j in tried):
                tried.append(i)
                yield from self._orders(self._refined([(c, k != i) for k, c in enumerate(colours)]))

    def _least(self, names: list):
        """The least writing over all orders of the nodes that _orders() has for these names."""
        best = None
        for order in self._orders(self._refined(names)):
            place = {i: k for k, i in enumerate(order)}
            edges = tuple(sorted((min(place[u], place[v]), max(place[u], place[v]), x) for u, v, x in self.edges))
            if best is None or edges < best[1]:
                best = (tuple(self.labels[i] for i in order), edges)
        return best

    @cached_property
    def orbits(self) -> tuple[int, ...]:
        """Of each node, the first node that an automorphism exchanges it with: they have the same images."""
        classes = self._refined([(x,) for x in self.labels])
        first, out = {}, []
        for i, c in enumerate(classes):
            alone = classes.count(c) == 1
            out.append(first.setdefault((c, None if alone else self._least([(x, k != i) for k, x in enumerate(self.labels)])), i))
        return tuple(out)

    @cached_property
    def code(self) -> str:
        """The same for two patterns just when they are isomorphic: the least writing over all orders in _orders()."""
        best = self._least([(x,) for x in self.labels])
        return " ".join(map(repr, best[0])) + "|" + " ".join(f"{u}-{v}:{x!r}" for u, v, x in best[1]) if best and best[0] else ""

    def with_node(self, at: int, label: float, edge: float) -> Pattern:
        return Pattern.of([*self.labels, label], [*self.edges, (at, self.n_nodes, edge)])

    def with_edge(self, u: int, v: int, edge: float) -> Pattern:
        return Pattern.of(self.labels, [*self.edges, (u, v, edge)])

    def without_edge(self, k: int) -> Pattern | None:
        """Less edge k and any node left alone; None if that is not connected."""
        rest = self.edges[:k] + self.edges[k + 1 :]
        keep = sorted({i for u, v, _ in rest for i in (u, v)})
        if not keep:
            return None
        place = {i: n for n, i in enumerate(keep)}
        out = Pattern.of([self.labels[i] for i in keep], [(place[u], place[v], x) for u, v, x in rest])
        return out if out.connected() else None

    def parts(self) -> dict[str, Pattern]:
        """Connected patterns of one edge less, one for each class, by code."""
        return {p.code: p for k in range(self.n_edges) if (p := self.without_edge(k))}

    def extensions(self, edge_types: set[tuple[float, float, float]]) -> Iterator[Pattern]:
        """All patterns of one edge more, by edge types (label, label, edge label), both ways round."""
        for i, mine in enumerate(self.labels):
            for a, b, x in sorted(edge_types):
                if a == mine:
                    yield self.with_node(i, b, x)
                    for j in range(i + 1, self.n_nodes):
                        if self.labels[j] == b and j not in self.around[i]:
                            yield self.with_edge(i, j, x)


def edge(a: float, b: float, x: float) -> Pattern:
    return Pattern.of([a, b], [(0, 1, x)])


def path(labels, edges) -> Pattern:
    return Pattern.of(labels, [(i, i + 1, x) for i, x in enumerate(edges)])


def star(centre: float, leaves, edges) -> Pattern:
    return Pattern.of([centre, *leaves], [(0, i + 1, x) for i, x in enumerate(edges)])


def two_edge(edge_types) -> dict[str, Pattern]:
    """Every two-edge pattern of the frequent edge types, by code: pairs of types that share an end's label."""
    both = {(a, b, x) for a, b, x in edge_types} | {(b, a, x) for a, b, x in edge_types}
    return {p.code: p for a, b, x in edge_types for p in edge(a, b, x).extensions(both)}
