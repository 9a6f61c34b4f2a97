"""Embeddings of a pattern: injective, label-preserving, not induced."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pattern import Pattern
from ..plans.graph import CachedGraph, Graph

#: Nodes up to which orders are compared by cost.
_PLANNED = 10


@dataclass(frozen=True)
class FanOuts:
    """How many vertices a label has that have edges at all, and how many edges there are of a kind: (label, edge label, label)."""

    vertices: dict[float, int]
    edges: dict[tuple[float, float, float], int]

    def rows(self, pattern: Pattern, nodes: frozenset[int]) -> float:
        """About how many partial embeddings these nodes have, were edges independent of each other."""
        out = 1.0
        for i in nodes:
            out *= self.vertices.get(pattern.labels[i], 0)
        for u, v, x in pattern.edges:
            if u in nodes and v in nodes:
                a, b = pattern.labels[u], pattern.labels[v]
                out *= self.edges.get((a, x, b), 0) / max(1, self.vertices.get(a, 0) * self.vertices.get(b, 0))
        return out


def fan_outs(graph: CachedGraph) -> FanOuts:
    return FanOuts(graph.label_sizes, {kind: edges for kind, (_, edges) in graph.fan_out.items()})


def join_order(pattern: Pattern, first: int | None = None, fan: FanOuts | None = None) -> list[int]:
    """Nodes so that each has an edge to one before it.

    With fan, the order whose partial embeddings are fewest in all, by dynamic programming over connected sets of nodes. Without it (or for
    many nodes) those that close most edges come first, then those of least degree.
    """
    if fan is not None and pattern.n_nodes <= _PLANNED:
        return _cheapest(pattern, first, fan)
    order = [min(range(pattern.n_nodes), key=lambda i: (-len(pattern.around[i]), i)) if first is None else first]
    while len(order) < pattern.n_nodes:
        ready = {j for i in order for j in pattern.around[i]} - set(order)
        order.append(min(ready, key=lambda j: (-sum(i in pattern.around[j] for i in order), len(pattern.around[j]), j)))
    return order


def _cheapest(pattern: Pattern, first: int | None, fan: FanOuts) -> list[int]:
    best = {frozenset([i]): (0.0 if first is not None else fan.rows(pattern, frozenset([i])), [i]) for i in (range(pattern.n_nodes) if first is None else [first])}
    for _ in range(pattern.n_nodes - 1):
        wider: dict[frozenset[int], tuple[float, list[int]]] = {}
        for nodes, (cost, order) in best.items():
            for i in sorted({j for k in nodes for j in pattern.around[k]} - nodes):
                grown = nodes | {i}
                candidate = (cost + fan.rows(pattern, grown), [*order, i])
                if grown not in wider or candidate < wider[grown]:
                    wider[grown] = candidate
        best = wider
    return min(best.values())[1]


def embeddings(graph: Graph, pattern: Pattern, domains: dict[int, DataFrame] | None = None, first: int | None = None) -> DataFrame:
    """Columns n0, n1, ... of the vertices that each node is mapped to, a row for each embedding.

    A chain of equi-joins: a new node joins on an edge to an earlier one. Where it closes cycles, the neighbour lists of all its earlier nodes
    are joined and intersected, the shortest first (of a hub's list, which is cut, a part at a time), so no wedge becomes a row. Labels are filtered below the joins. Only
    nodes of equal label can meet in one vertex, so only those are compared. domains restricts nodes.
    """
    graph = graph.cached()
    if pattern.n_nodes == 1:
        return graph.vertices.where(F.col("label") == pattern.labels[0]).select(F.col("id").alias("n0"))
    fan = fan_outs(graph)
    order, rows = join_order(pattern, first, fan), None
    usual = lambda j, i: fan.edges.get((pattern.labels[j], pattern.around[i][j], pattern.labels[i]), 0) / max(1, fan.vertices.get(pattern.labels[j], 0))
    for k, i in enumerate(order[1:], 1):
        before = sorted((j for j in order[:k] if j in pattern.around[i]), key=lambda j: usual(j, i))
        if len(before) > 1:
            rows = _closed(graph, pattern, rows, i, before)
            before = []
        for j in before:
            arcs = graph.adj.where((F.col("src_label") == pattern.labels[j]) & (F.col("dst_label") == pattern.labels[i]) & (F.col("label") == pattern.around[i][j])).select(F.col("src").alias(f"n{j}"), F.col("dst").alias(f"n{i}"))
            if rows is None:
                rows = arcs
                if domains:
                    rows = rows.join(domains[j].select(F.col("id").alias(f"n{j}")), f"n{j}", "left_semi")
            else:
                rows = rows.join(arcs, f"n{j}")
        for j in order[:k]:
            if pattern.labels[j] == pattern.labels[i]:
                rows = rows.where(F.col(f"n{j}") != F.col(f"n{i}"))
        if domains:
            rows = rows.join(domains[i].select(F.col("id").alias(f"n{i}")), f"n{i}", "left_semi")
    return rows.select(*(f"n{i}" for i in range(pattern.n_nodes)))


def _closed(graph: CachedGraph, pattern: Pattern, rows: DataFrame, i: int, before: list[int]) -> DataFrame:
    """rows with node i, which has edges to several nodes."""
    names, c = rows.columns, None
    for j in before:
        own = graph.lists.where((F.col("label") == pattern.around[i][j]) & (F.col("dst_label") == pattern.labels[i]) & (F.col("src_label") == pattern.labels[j]))
        rows = rows.join(own.select(F.col("src").alias(f"n{j}"), "dsts"), f"n{j}").select(*names, ("dsts" if c is None else F.array_intersect("c", "dsts").alias("c")))
        rows = rows.withColumnRenamed("dsts", "c").where(F.size("c") > 0)
        c = "c"
    return rows.select(*names, F.explode("c").alias(f"n{i}"))
