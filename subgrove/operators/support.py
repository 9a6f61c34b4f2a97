"""Minimum node image (MNI) support: the least number of distinct vertices that a pattern node is mapped to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pattern import Pattern
from ..plans.graph import CachedGraph, Graph
from ..plans.shared import kept, lookup, remove, stored
from . import domains as D
from .embeddings import join_order
from .search import Images, Task, signatures, sought, valid, witnesses


def images(graph: Graph, pattern: Pattern, part: tuple[int, int] | None = None) -> DataFrame:
    """col and id: the vertices that each node is mapped to in some embedding. part (k, n): of ids with id mod n = k only.

    A star whose leaves all differ in label from its centre counts neighbours instead of joining them. A tree of
    distinct labels needs semi-joins only: no two nodes can meet, so its arc-consistent domains are the images.
    Of all others nodes are searched for one after the other, each from the candidates that the embeddings
    found so far don't hold (see Images); what is found is a table, which stays.
    """
    graph = graph.cached()
    mine = None if part is None else F.pmod("id", F.lit(part[1])) == part[0]
    kept_by = lambda df: df if mine is None else df.where(mine)
    if (centre := star_centre(pattern)) is not None:
        return _star_images(graph, pattern, centre, mine)
    if pattern.acyclic() and pattern.unique_labels():
        return kept_by(D.as_table(D.tree_domains(graph, pattern)))
    found = search_all(graph, pattern, mine)
    out = kept_by(found.table(""))
    found.paths = [p for p in found.paths if p != found.known_path]
    found.known_path = ""
    found.drop()
    return out


def search_all(graph: CachedGraph, pattern: Pattern, within: Column | None = None) -> Images:
    """The images of every orbit of a pattern, those of the smallest domains for their degree first."""
    found = Images(graph, {"": pattern})
    found.complete({"": column_order(pattern, {i: graph.label_sizes.get(x, 0) for i, x in enumerate(pattern.labels)})}, within=within)
    if found.known is None:
        found.search([("", 0)], F.lit(False))
    return found


def star_centre(pattern: Pattern) -> int | None:
    """The centre of a star whose leaves all differ in label from the centre."""
    if not pattern.acyclic() or pattern.n_edges < 2:
        return None
    centre = max(range(pattern.n_nodes), key=lambda i: len(pattern.around[i]))
    rest = [x for i, x in enumerate(pattern.labels) if i != centre]
    # a vertex joined to the centre has one edge to it, so leaves of one label compete only within a kind
    return centre if len(pattern.around[centre]) == pattern.n_edges and pattern.labels[centre] not in rest else None


def _star_images(graph: Graph, pattern: Pattern, centre: int, mine: Column | None) -> DataFrame:
    """A vertex is a centre if it has enough neighbours of each kind; any neighbour of a kind is then a leaf.

    Domains count neighbours by kind (edge label and leaf label), with no join of leaves to each other.
    """
    own = D.domains(graph, pattern)[centre]
    found = {centre: own}
    for i in pattern.around[centre]:
        arcs = graph.adj.where((F.col("src_label") == pattern.labels[centre]) & (F.col("dst_label") == pattern.labels[i]) & (F.col("label") == pattern.around[centre][i]))
        arcs = arcs if mine is None else arcs.select("src", F.col("dst").alias("id")).where(mine).withColumnRenamed("id", "dst")
        found[i] = arcs.join(own.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    return D.as_table({i: d if mine is None else d.where(mine) for i, d in found.items()})


def _least(counts: DataFrame, pattern: Pattern) -> DataFrame:
    """One row mni, from counts col, n; a node without images counts 0."""
    return counts.agg(F.when(F.count("*") < pattern.n_nodes, F.lit(0)).otherwise(F.min("n")).cast("long").alias("mni"))


def mni(graph: Graph, pattern: Pattern) -> DataFrame:
    """One row: mni."""
    return _least(images(graph, pattern).groupBy("col").agg(F.count("*").alias("n")), pattern)


def mni_table(graph: Graph, pattern: Pattern) -> DataFrame:
    """col and n, the number of images of every node."""
    every = graph.vertices.sparkSession.range(pattern.n_nodes).select(F.col("id").cast("int").alias("col"))
    counts = images(graph, pattern).groupBy("col").agg(F.count("*").alias("n"))
    return every.join(counts, "col", "left").select("col", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def mni_partitioned(graph: Graph, pattern: Pattern, parts: int) -> DataFrame:
    """The same mni from parts of the ids (id mod parts), each searched for by itself; their counts are summed, as parts are disjoint."""
    graph = graph.cached()
    each = [images(graph, pattern, (k, parts)).groupBy("col").agg(F.count("*").alias("n")) for k in range(parts)]
    return _least(reduce(DataFrame.unionByName, each).groupBy("col").agg(F.sum("n").alias("n")), pattern)


def column_images(graph: Graph, pattern: Pattern, col: int, seeds: DataFrame | None = None) -> DataFrame:
    """ids that one node is mapped to, of seeds (id) if given, without a table of what is found."""
    graph = graph.cached()
    sigs = signatures([pattern])
    domains = D.many_domains(graph, list(sigs)) if pattern.n_nodes > 1 else graph.by_label(pattern.labels[0]).select(F.lit(0).alias("sig"), "id")
    own = domains.where(F.col("sig") == sigs[D.signature(pattern, col)]).select(F.lit(0).alias("task"), "id")
    own = own if seeds is None else own.join(seeds.select("id"), "id", "left_semi").select("task", "id")
    return sought(graph, {0: Task.of(graph, pattern, col)}, own, domains, sigs).select("id").distinct()


def first_embedding(graph: Graph, pattern: Pattern, col: int, seeds: DataFrame, ways: int = 8) -> DataFrame:
    """For each seed (id) that node col can be mapped to, one embedding: columns n0, n1, ...; the least one in the order of join_order(pattern, col).

    Each seed is searched along its least partial embeddings only, so many at a time as ways. Seeds for which that finds
    none are first asked for whether they have an embedding at all; those that have are searched again with sixteen times as many, until each has one.
    """
    graph = graph.cached()
    spark, sigs = graph.vertices.sparkSession, signatures([pattern])
    domains, path = kept(D.many_domains(graph, list(sigs)))
    task = {0: Task(pattern, tuple(join_order(pattern, col)))}
    rest = domains.where(F.col("sig") == sigs[D.signature(pattern, col)]).join(seeds.select("id").distinct(), "id", "left_semi").select(F.lit(0).alias("task"), "id")
    found, rest_path = [], None
    while True:
        found.append(stored(witnesses(graph, task, rest, ways, least=True)))
        rest = rest.join(found[-1].select("task", F.col("seed").alias("id")), ["task", "id"], "left_anti")
        rest = valid(graph, task, rest, domains, sigs) if len(found) == 1 else rest
        before = rest_path
        rest, rest_path = kept(rest)
        if before:
            remove(spark, before)
        if rest.isEmpty():
            break
        ways *= 16
    remove(spark, path)
    remove(spark, rest_path)
    place = {i: k for k, i in enumerate(task[0].order)}
    return reduce(DataFrame.unionByName, found).select(*(F.element_at("m", place[i] + 1).alias(f"n{i}") for i in range(pattern.n_nodes)))


def column_order(pattern: Pattern, sizes: dict[int, int], suspect: int | None = None) -> list[int]:
    """Nodes in the order in which their images are counted: a suspect first, then by domain size over degree."""
    return sorted(range(pattern.n_nodes), key=lambda i: (i != suspect, sizes.get(i, 0) // max(1, len(pattern.around[i])), i))


def refuted_by(graph: Graph, pattern: Pattern, support: int) -> int | None:
    """The first node, in column_order(), if its images alone show that the pattern is infrequent, else None. Its own arcs are looked at before it is searched for."""
    graph = graph.cached()
    sizes = {r["col"]: r["count"] for r in D.as_table(D.domains(graph, pattern)).groupBy("col").count().collect()}
    col = column_order(pattern, sizes)[0]
    return col if sizes.get(col, 0) < support or column_images(graph, pattern, col, D.at_node(graph, pattern, col)).count() < support else None


#: Bits of a word of a bitmap of stars.
_WORD = 60


def star_leaves(graph: Graph, centres: DataFrame, stars: list[tuple[int, float, float, float]], leaves: DataFrame | None = None) -> DataFrame:
    """centre, label, dst_label and n: of stars (centre's sig, centre's label, edge label, leaf label), how many leaves there are of a kind.

    Each vertex carries one bitmap of the centres' sigs it is in (centres: sig, id), a row for each 60 of them; edges are joined to it once, however many
    stars there are, and the bitmaps of a leaf's edges are or-ed, in the map tasks first. Bits are counted last. leaves (sig, id) and a fifth entry
    in stars, the leaf's sig: only leaves in it count; their bitmaps are and-ed, pair by pair.
    """
    spark, sigs = graph.vertices.sparkSession, sorted({s[0] for s in stars})
    place = {s: k for k, s in enumerate(sigs)}
    bits = lookup(spark, [(s, k // _WORD, 1 << (k % _WORD)) for s, k in place.items()], "sig int, word int, bit long")
    maps = centres.join(bits, "sig").groupBy(F.col("id").alias("src"), "word").agg(F.bit_or("bit").alias("bits"))
    kinds = lookup(spark, sorted({s[1:4] for s in stars}), "src_label double, label double, dst_label double")
    arcs = graph.adj.join(kinds, ["src_label", "label", "dst_label"]).join(maps, "src")
    met = arcs.groupBy("src_label", "label", "dst_label", "dst", "word").agg(F.bit_or("bits").alias("bits"))
    if leaves is None:
        wanted = [(*s[1:4], s[0], place[s[0]] // _WORD, 1 << (place[s[0]] % _WORD)) for s in sorted(set(stars))]
        asked = lookup(spark, wanted, "src_label double, label double, dst_label double, centre int, word int, bit long")
        by_bits = met.groupBy("src_label", "label", "dst_label", "word", "bits").agg(F.count("*").alias("n"))  # leaves of equal bitmaps are counted together
        hit = by_bits.join(asked, ["src_label", "label", "dst_label", "word"]).where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
        return hit.groupBy("centre", "label", "dst_label").agg(F.sum("n").alias("n"))
    own = sorted({s[4] for s in stars})
    spot = {s: k for k, s in enumerate(own)}
    leaf_bits = lookup(spark, [(s, k // _WORD, 1 << (k % _WORD)) for s, k in spot.items()], "sig int, leaf_word int, bit long")
    leaf_maps = leaves.join(leaf_bits, "sig").groupBy(F.col("id").alias("dst"), "leaf_word").agg(F.bit_or("bit").alias("leaf_bits"))
    wanted = [(*s[1:4], s[0], place[s[0]] // _WORD, 1 << (place[s[0]] % _WORD), s[4], spot[s[4]] // _WORD, 1 << (spot[s[4]] % _WORD)) for s in sorted(set(stars))]
    asked = lookup(spark, wanted, "src_label double, label double, dst_label double, centre int, word int, bit long, leaf int, leaf_word int, leaf_bit long")
    by_bits = met.join(leaf_maps, "dst").groupBy("src_label", "label", "dst_label", "word", "bits", "leaf_word", "leaf_bits").agg(F.count("*").alias("n"))
    hit = by_bits.join(asked, ["src_label", "label", "dst_label", "word", "leaf_word"])
    hit = hit.where((F.col("bits").bitwiseAND(F.col("bit")) != 0) & (F.col("leaf_bits").bitwiseAND(F.col("leaf_bit")) != 0))
    return hit.groupBy("centre", "leaf", "label", "dst_label").agg(F.sum("n").alias("n"))


def star_supports(graph: Graph, patterns: dict[str, Pattern]) -> dict[str, int]:
    """mni of many stars (of star_centre()) in one plan: centres are found together, by kinds of edges; then their leaves."""
    sigs, stars = {}, set()
    for p in patterns.values():
        c = star_centre(p)
        k = sigs.setdefault(D.signature(p, c), len(sigs))
        stars |= {(k, p.labels[c], x, y) for x, y, _ in D.needs(p, c)}
    if not sigs:
        return {}
    centres = D.many_domains(graph, list(sigs))
    sizes = centres.groupBy(F.col("sig").alias("centre")).agg(F.count("*").alias("n"))
    counts = star_leaves(graph, centres, sorted(stars)).select("centre", "n").unionByName(sizes)
    least = {r["centre"]: (r["n"], r["k"]) for r in counts.groupBy("centre").agg(F.min("n").alias("n"), F.count("*").alias("k")).collect()}
    out = {}
    for code, p in patterns.items():
        c = star_centre(p)
        n, k = least.get(sigs[D.signature(p, c)], (0, 0))
        out[code] = n if k == 1 + len(D.needs(p, c)) else 0
    return out


def supports(graph: Graph, patterns: dict[str, Pattern], support: int = 0, sizes: dict[str, dict[int, int]] | None = None, suspects: dict[str, int] | None = None) -> dict[str, int]:
    """mni of many patterns. Where it is below support, some number below support, as soon as one node shows it.

    Stars are one plan. Of all other patterns the first orbit of column_order() is searched, for all of them together, then the next of those that
    are left, and so on. What a search finds of other nodes is not searched for again.
    """
    graph = graph.cached()
    stars = {c: p for c, p in patterns.items() if star_centre(p) is not None}
    out = star_supports(graph, stars)
    rest = {c: p for c, p in patterns.items() if c not in stars}
    if not rest:
        return out
    orders = {c: column_order(p, (sizes or {}).get(c, {}), (suspects or {}).get(c)) for c, p in rest.items()}
    found = Images(graph, rest)
    out |= found.complete(orders, max(support, 1))
    found.drop()
    return out


__all__ = ["images", "mni", "mni_table", "mni_partitioned", "column_images", "column_order", "first_embedding", "refuted_by", "search_all", "star_centre", "star_leaves", "star_supports", "supports"]
