"""Candidate vertices of each pattern node: by label and degree, and arc-consistent."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pattern import Pattern
from ..plans.graph import Graph, of_kinds
from ..plans.shared import kept, lookup, remove, stored


def needs(pattern: Pattern, i: int) -> tuple[tuple[float, float, int], ...]:
    """The kinds of edges that a node has: edge label, label at the other end, how many."""
    count = Counter((x, pattern.labels[j]) for j, x in pattern.around[i].items())
    return tuple((x, y, n) for (x, y), n in sorted(count.items()))


def domains(graph: Graph, pattern: Pattern) -> dict[int, DataFrame]:
    """Of each node: ids of its label that have, for every kind of edge and neighbour it has, at least as many."""
    out = {}
    for i, label in enumerate(pattern.labels):
        rows, own = graph.kinds.where(F.col("src_label") == label), needs(pattern, i)
        if not own:
            out[i] = graph.by_label(label)
            continue
        enough = reduce(lambda a, b: a | b, ((F.col("label") == x) & (F.col("dst_label") == y) & (F.col("n") >= n) for x, y, n in own))
        found = rows.where(enough).select(F.col("src").alias("id"))
        out[i] = found if len(own) == 1 else found.groupBy("id").agg(F.count("*").alias("k")).where(F.col("k") == len(own)).select("id")
    return out


def signature(pattern: Pattern, i: int) -> tuple:
    """What a node's domain depends on: nodes of one signature have one domain."""
    return pattern.labels[i], needs(pattern, i)


def many_domains(graph: Graph, signatures: list[tuple]) -> DataFrame:
    """sig (a place in signatures) and id, for many domains in one plan: the vertices' kinds of edges joined to the
    needs of all signatures, a table with a row for each kind in a signature (patterns are small, and so is it). Where
    kinds is bucketed by vertex, nothing is dealt out."""
    rows = [(k, label, x, y, n, len(own)) for k, (label, own) in enumerate(signatures) for x, y, n in own]
    wanted = lookup(graph.vertices.sparkSession, rows, "sig int, src_label double, label double, dst_label double, need int, total int")
    met = graph.kinds.where(of_kinds((a, x, y) for _, a, x, y, _, _ in rows)).join(wanted, ["src_label", "label", "dst_label"]).where("n >= need").select("sig", F.col("src").alias("id"), "total")
    return met.groupBy("sig", "id", "total").agg(F.count("*").alias("k")).where("k = total").select("sig", "id")


def degree_domains(graph: Graph, pattern: Pattern) -> DataFrame:
    """col and id: vertices of the node's label whose degree is at least the node's."""
    deg = graph.degrees()
    parts = [deg.where((F.col("label") == x) & (F.col("degree") >= len(pattern.around[i]))).select(F.lit(i).alias("col"), "id") for i, x in enumerate(pattern.labels)]
    return reduce(DataFrame.unionByName, parts)


def _arc(graph: Graph, pattern: Pattern, i: int, j: int, mine: DataFrame, other: DataFrame) -> DataFrame:
    """Those of node i's ids that have a neighbour among node j's, over the pattern's edge."""
    x = pattern.around[i][j]
    arcs = graph.adj.where((F.col("src_label") == pattern.labels[i]) & (F.col("dst_label") == pattern.labels[j]) & (F.col("label") == x)).select("src", "dst")
    kept = arcs.join(other.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
    return mine.join(kept, "id", "left_semi")


def tree_domains(graph: Graph, pattern: Pattern, start: dict[int, DataFrame] | None = None) -> dict[int, DataFrame]:
    """Arc-consistent domains of a tree pattern by two passes of semi-joins, leaves to root and back.

    Nothing is run or written: a plan has as many semi-joins as the tree has arcs, twice. Only trees of
    many nodes, whose plans would hold each other many times, are written step by step.
    """
    cut = stored if pattern.n_nodes > 6 else lambda df: df
    found = dict(start or domains(graph, pattern))
    order, parent = [0], {0: None}
    for i in order:
        for j in pattern.around[i]:
            if j not in parent:
                parent[j] = i
                order.append(j)
    for i in reversed(order[1:]):
        found[parent[i]] = cut(_arc(graph, pattern, parent[i], i, found[parent[i]], found[i]))
    for i in order[1:]:
        found[i] = cut(_arc(graph, pattern, i, parent[i], found[i], found[parent[i]]))
    return found


def at_node(graph: Graph, pattern: Pattern, i: int, start: dict[int, DataFrame] | None = None) -> DataFrame:
    """Those of a node's candidates that have a neighbour in the domain at the other end of each of its edges: the arcs of a suspect node alone."""
    start = start or domains(graph, pattern)
    return reduce(lambda own, j: _arc(graph, pattern, i, j, own, start[j]), sorted(pattern.around[i]), start[i])


def ac3_domains(graph: Graph, pattern: Pattern, max_rounds: int | None = None, suspect: int | None = None) -> dict[int, DataFrame]:
    """Arc-consistent domains of any pattern (or what is left after max_rounds), the arcs of a suspect node first.

    A tree needs two passes of semi-joins. Otherwise each candidate's supporters, its neighbours in the domain at the other end, are
    counted once for every arc. A round then takes only the vertices that the last one removed: their neighbours lose
    a supporter each, and those that have lost all along some arc are removed next. What has been lost is a log beside the
    counters, so a round reads what it touches and rewrites nothing.
    """
    graph = graph.cached()
    if pattern.acyclic():
        return tree_domains(graph, pattern)
    spark, start, paths = graph.vertices.sparkSession, domains(graph, pattern), []

    def table(df: DataFrame) -> DataFrame:
        out, path = kept(df)
        paths.append(path)
        return out

    if suspect is not None:
        start[suspect] = at_node(graph, pattern, suspect, start)
    own = table(as_table(start))
    arcs = [(i, j, x, pattern.labels[j], len(pattern.around[i])) for i in range(pattern.n_nodes) for j, x in sorted(pattern.around[i].items())]
    asked = lookup(spark, arcs, "col int, end int, edge double, label_there double, n_arcs int")
    adj = graph.adj.where(of_kinds((pattern.labels[i], x, y) for i, _, x, y, _ in arcs)).select("src", "dst", "label", "dst_label")
    same = (F.col("src") == F.col("id")) & (F.abs(F.col("label") - F.col("edge")) == 0) & (F.abs(F.col("dst_label") - F.col("label_there")) == 0)
    key = ["col", "end", "id"]
    there = own.select(F.col("col").alias("end"), F.col("id").alias("dst"))
    counters = table(own.join(asked, "col").join(adj, same).join(there, ["end", "dst"], "left_semi").groupBy(*key, "n_arcs").agg(F.count("*").alias("n")))
    whole = counters.groupBy("col", "id", "n_arcs").agg(F.count("*").alias("k")).where("k = n_arcs").select("col", "id")
    removed = table(own.join(whole, ["col", "id"], "left_anti"))
    gone, lost, rounds = [removed], [], 0
    while (max_rounds is None or rounds < max_rounds) and not gone[-1].isEmpty():
        rounds += 1
        back = lookup(spark, [(i, j, x, pattern.labels[i]) for i, j, x, _, _ in arcs], "col int, end int, edge double, label_there double")
        hit = gone[-1].withColumnRenamed("col", "end").join(back, "end").join(adj, same).select("col", "end", F.col("dst").alias("id"))
        lost.append(table(hit.groupBy(*key).agg(F.count("*").alias("k"))))
        so_far = reduce(DataFrame.unionByName, lost).join(lost[-1].select(*key), key, "left_semi").groupBy(*key).agg(F.sum("k").alias("k"))
        empty = counters.join(so_far, key).where("k >= n").select("col", "id").distinct()
        gone.append(table(empty.join(reduce(DataFrame.unionByName, gone), ["col", "id"], "left_anti")))
    left = stored(own.join(reduce(DataFrame.unionByName, gone), ["col", "id"], "left_anti"))
    for path in paths:
        remove(spark, path)
    return {i: left.where(F.col("col") == i).select("id") for i in range(pattern.n_nodes)}


def as_table(found: dict[int, DataFrame]) -> DataFrame:
    """col and id."""
    return reduce(DataFrame.unionByName, [d.select(F.lit(i).alias("col"), "id") for i, d in sorted(found.items())])
