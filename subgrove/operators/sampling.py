"""Support estimated from a sample of each node's candidates."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pattern import Pattern
from ..plans.graph import CachedGraph, Graph
from ..plans.shared import lookup
from . import domains as D
from .search import Task, signatures, sought
from .support import star_centre, star_leaves

_SHARES = 1 << 32


@dataclass(frozen=True)
class Draw:
    """Which candidates are drawn: those whose id is divisible by every, or else about size of them, those of the
    least hashes (the leading 32 bits of md5 of "seed:id"); a domain no larger than size is taken whole. Either way a draw is a test of the id
    alone: the same on every run, without repetition, and without sorting a domain. A smaller draw is part of a larger one; after: less what a draw of
    that size has."""

    size: int = 300
    every: int | None = None
    z: float = 2.58
    seed: int = 42
    after: int = 0

    def __call__(self, ids: Column, domain: Column) -> Column:
        if self.every:
            return F.pmod(ids, F.lit(self.every)) == 0
        place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{self.seed}:"), ids.cast("string"))), 1, 8), 16, 10).cast("long")
        below = lambda size: (domain <= size) | (place < F.ceil(F.lit(float(_SHARES * size)) / F.greatest(domain, F.lit(1))))
        return below(self.size) & ~below(self.after) if self.after else below(self.size)


def sampled_fraction(graph: Graph, pattern: Pattern, every: int) -> DataFrame:
    """col, sampled, valid and estimate: of the candidates whose id is divisible by every, those that are images."""
    rows = drawn(graph.cached(), {"": pattern}, Draw(every=every))
    return rows.select("col", F.col("n").alias("sampled"), "valid", (F.col("valid") * every).cast("long").alias("estimate"))


def judged(counts: DataFrame, support: int, z: float) -> DataFrame:
    """Adds estimate, low, high and verdict to rows with domain, n (drawn) and valid.

    low and high are the Wilson interval of a proportion, z standard errors wide, times the domain: of nothing found
    in a sample it does not follow that there is nothing. Where the whole domain was drawn both are the count.
    """
    n, p = F.greatest("n", F.lit(1)).cast("double"), F.col("valid") / F.greatest("n", F.lit(1))
    middle, wide = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    whole, none = F.col("n") == F.col("domain"), F.col("n") == 0
    out = counts.withColumns({
        "estimate": F.col("domain") * F.col("valid") / F.greatest("n", F.lit(1)),
        "low": F.when(whole, F.col("valid").cast("double")).when(none, 0.0).otherwise(F.col("domain") * (middle - wide)),
        "high": F.when(whole, F.col("valid").cast("double")).when(none, F.col("domain").cast("double")).otherwise(F.col("domain") * (middle + wide)),
    })
    verdict = F.when(F.col("low") >= support, "frequent").when(F.col("high") < support, "infrequent").otherwise("uncertain")
    return out.withColumn("verdict", verdict)


def drawn(graph: CachedGraph, patterns: dict[str, Pattern], draw: Draw, arcs: bool = False) -> DataFrame:
    """code, col, domain, n (drawn) and valid of each node of many patterns, in one plan: the seeds of all nodes are searched for together.

    Of nodes that an automorphism exchanges one is drawn, which speaks for all. arcs: of a node's domain only those vertices count that have, along each edge
    of the pattern, a neighbour in the domain at its other end; not worth it in dense graphs.
    """
    spark = graph.vertices.sparkSession
    sigs = signatures(patterns.values())
    domains = D.many_domains(graph, list(sigs))
    nodes = [(c, i) for c, p in sorted(patterns.items()) for i in sorted(set(p.orbits))]
    tasks = {t: Task.of(graph, patterns[c], i) for t, (c, i) in enumerate(nodes)}
    named = lookup(spark, [(t, sigs[D.signature(patterns[c], i)]) for t, (c, i) in enumerate(nodes)], "task int, sig int")
    own = domains.join(named, "sig").select("task", "id")
    if arcs:
        own = _met(graph, nodes, patterns, own, domains, sigs)
    sizes = own.groupBy("task").agg(F.count("*").alias("domain"))
    seeds = own.join(F.broadcast(sizes), "task").where(draw(F.col("id"), F.col("domain"))).select("task", "id")  # a row for each node of a pattern
    n = seeds.groupBy("task").agg(F.count("*").alias("n"))
    valid = sought(graph, tasks, seeds, domains, sigs).groupBy("task").agg(F.count("*").alias("valid"))
    names = lookup(spark, [(t, c, j) for t, (c, i) in enumerate(nodes) for j, o in enumerate(patterns[c].orbits) if o == i], "task int, code string, col int")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return names.join(sizes, "task", "left").join(n, "task", "left").join(valid, "task", "left").select("code", "col", *map(count, ("domain", "n", "valid")))


def _met(graph: CachedGraph, nodes: list[tuple[str, int]], patterns: dict[str, Pattern], own: DataFrame, domains: DataFrame, sigs: dict) -> DataFrame:
    """Of own (task, id) those that meet a vertex of the right domain along every edge of their node, for all tasks at once."""
    ends = [(t, k, x, patterns[c].labels[j], sigs[D.signature(patterns[c], j)], len(patterns[c].around[i])) for t, (c, i) in enumerate(nodes) for k, (j, x) in enumerate(sorted(patterns[c].around[i].items()))]
    asked = lookup(graph.vertices.sparkSession, ends, "task int, end int, label double, dst_label double, sig int, total int")
    arcs = own.withColumnRenamed("id", "src").join(asked, "task").join(graph.adj.select("src", "label", "dst_label", "dst"), ["src", "label", "dst_label"])
    hit = arcs.join(domains.select("sig", F.col("id").alias("dst")), ["sig", "dst"], "left_semi").select("task", F.col("src").alias("id"), "total", "end").distinct()
    return hit.groupBy("task", "id", "total").agg(F.count("*").alias("k")).where("k = total").select("task", "id")


def support_interval(graph: Graph, pattern: Pattern, support: int, draw: Draw = Draw(), arcs: bool = False) -> DataFrame:
    """col, domain, n, valid, estimate, low, high and verdict (frequent, infrequent or uncertain) of each node."""
    return judged(drawn(graph.cached(), {"": pattern}, draw, arcs).drop("code"), support, draw.z)


def judge(domain: int, n: int, valid: int, support: int, z: float) -> tuple[float, str]:
    """Estimate and verdict as of judged()."""
    m = max(n, 1)
    p = valid / m
    middle, wide = (p + z * z / (2 * m)) / (1 + z * z / m), z * math.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    low, high = (valid, valid) if n == domain else (0.0, domain) if n == 0 else (domain * (middle - wide), domain * (middle + wide))
    return domain * valid / m, "frequent" if low >= support else "infrequent" if high < support else "uncertain"


def _star_counts(graph: CachedGraph, stars: dict[str, Pattern], draw: Draw) -> dict[str, list[tuple[int, int, int]]]:
    """(domain, n, valid) for each node of many stars, in one plan.

    Domains and centres are found together for all stars. A centre's domain is its images; a drawn leaf is valid if
    one of its neighbours is a centre.
    """
    spark = graph.vertices.sparkSession
    sigs: dict[tuple, int] = {}
    pairs = {}
    for p in stars.values():
        c = star_centre(p)
        mine = sigs.setdefault(D.signature(p, c), len(sigs))
        for i in p.around[c]:
            pairs[mine, sigs.setdefault(D.signature(p, i), len(sigs))] = (p.labels[c], p.around[c][i], p.labels[i])
    found = D.many_domains(graph, list(sigs))
    sizes = found.groupBy("sig").agg(F.count("*").alias("domain"))
    drawn_ = found.join(F.broadcast(sizes), "sig").where(draw(F.col("id"), F.col("domain"))).select("sig", "id")
    n = drawn_.groupBy("sig").agg(F.count("*").alias("n"))
    own = sizes.join(n, "sig", "left").select(F.col("sig").alias("centre"), F.lit(-1).alias("leaf"), "domain", F.coalesce("n", F.lit(0)).alias("n"))
    leaf = lookup(spark, [(a, b) for a, b in sorted(pairs)], "centre int, leaf int")
    met = star_leaves(graph, found, [(a, *k, b) for (a, b), k in sorted(pairs.items())], drawn_)
    valid = met.groupBy("centre", "leaf").agg(F.sum("n").alias("valid"))
    of_leaf = own.select(F.col("centre").alias("leaf"), "domain", "n")
    rows = own.withColumn("valid", F.col("n")).unionByName(leaf.join(of_leaf, "leaf").join(valid, ["centre", "leaf"], "left").select("centre", "leaf", "domain", "n", F.coalesce("valid", F.lit(0)).alias("valid")))
    known = {(r["centre"], r["leaf"]): (r["domain"], r["n"], r["valid"]) for r in rows.collect()}
    out = {}
    for code, p in stars.items():
        c = star_centre(p)
        mine = sigs[D.signature(p, c)]
        out[code] = [known.get((mine, -1 if i == c else sigs[D.signature(p, i)]), (0, 0, 0)) for i in range(p.n_nodes)]
    return out


def counted(graph: CachedGraph, patterns: dict[str, Pattern], draw: Draw, arcs: bool = False) -> dict[str, list[tuple[int, int, int]]]:
    """(domain, n, valid) for each node of many patterns: stars are one plan, all others are searched for in one plan."""
    stars = {c: p for c, p in patterns.items() if star_centre(p) is not None}
    out = _star_counts(graph, stars, draw) if stars else {}
    if rest := {c: p for c, p in patterns.items() if c not in stars}:
        for r in sorted(drawn(graph, rest, draw, arcs).collect(), key=lambda r: (r["code"], r["col"])):
            out.setdefault(r["code"], []).append((r["domain"], r["n"], r["valid"]))
    return out


def intervals(graph: Graph, patterns: dict[str, Pattern], support: int, draws: list[Draw], arcs: bool = False) -> dict[str, list[tuple]]:
    """(domain, n, valid, estimate, verdict) for each node of many patterns, by one draw after the other.

    A test in sequence: after each draw only patterns that it leaves uncertain go on, and what has been
    drawn for them before counts, too. draws: of growing size.
    """
    counts: dict[str, list[tuple[int, int, int]]] = {}
    out: dict[str, list[tuple]] = {}
    rest = patterns
    for k, draw in enumerate(draws):
        if not rest:
            break
        more = counted(graph.cached(), rest, replace(draw, after=draws[k - 1].size) if k else draw, arcs)
        for c, rows in more.items():
            counts[c] = [(d, n + m, v + w) for (d, n, v), (_, m, w) in zip(rows, counts[c], strict=True)] if k else rows
            out[c] = [(d, n, v, *judge(d, n, v, support, draw.z)) for d, n, v in counts[c]]
        rest = {c: p for c, p in rest.items() if verdict(out[c])[1] == "uncertain"}
    return out


def verdict(columns: list[tuple]) -> tuple[float, str, int]:
    """Of a pattern: the least estimate, the verdict, and the node that fails first. exact: every domain was drawn whole."""
    low = min(range(len(columns)), key=lambda i: (columns[i][4] != "infrequent", columns[i][3], i))
    said = {c[4] for c in columns}
    exact = all(c[0] == c[1] for c in columns)
    out = "infrequent" if "infrequent" in said else "exact" if exact else "uncertain" if "uncertain" in said else "frequent"
    return min(c[3] for c in columns), out, low


def sampled_support(graph: Graph, pattern: Pattern, support: int, draw: Draw = Draw()) -> tuple[float, str]:
    """The least estimate over nodes, and the verdict on the pattern."""
    estimate, said, _ = verdict(intervals(graph, {"": pattern}, support, [draw])[""])
    return estimate, "frequent" if said == "exact" else said


def quartiles(df: DataFrame, column: str, by: str) -> DataFrame:
    """q1, q2, q3 and the outlier fence q3 + 1.5 (q3 - q1) of a column in each group, by index floor(n q) of the ascending values.

    Values are counted first, so a group is ordered by its distinct values and not by its rows.
    """
    counted = df.groupBy(by, column).agg(F.count("*").alias("c"))
    order = W.partitionBy(by).orderBy(column)
    running = counted.withColumn("upto", F.sum("c").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("n", F.sum("c").over(W.partitionBy(by)))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("n") * q), F.col(column)))
    out = running.groupBy(by).agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    return out.withColumn("fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
