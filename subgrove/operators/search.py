"""Search for embeddings from seeds, for many patterns and nodes in one plan.

A task is a pattern and one of its nodes; its seeds are vertices that this node may be mapped to. A row is a partial embedding: task, seed
and m, the vertices so far in the task's order of nodes. All tasks whose steps have as many edges to earlier nodes go side by side: a step joins the rows
to the neighbour lists of a vertex each, intersects them with those of further vertices where the new node closes
cycles, and takes new vertices from what is left.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pattern import Pattern
from ..plans.graph import CachedGraph, of_kinds
from ..plans.shared import kept, lookup, remove
from . import domains as D
from .embeddings import fan_outs, join_order

#: Ways on that are followed from a partial embedding, and partial embeddings of a seed, before the seed is left for the whole search.
WAYS, MOST = 4, 64
#: Candidates up to which all nodes are searched at once.
WAVE = 200_000


@dataclass(frozen=True)
class Task:
    pattern: Pattern
    order: tuple[int, ...]

    @staticmethod
    def of(graph: CachedGraph, pattern: Pattern, col: int) -> Task:
        return Task(pattern, tuple(join_order(pattern, col, fan_outs(graph))))

    def ends(self, k: int) -> list[tuple[int, float]]:
        """Of the k-th node, the places of earlier nodes that it has an edge to, and the edges' labels."""
        around = self.pattern.around[self.order[k]]
        return [(p, around[j]) for p, j in enumerate(self.order[:k]) if j in around]

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(len(self.ends(k)) for k in range(1, len(self.order)))

    def wanted(self, k: int) -> list[bool]:
        """Which of the first k + 1 nodes later ones have an edge to, or the label of."""
        p, later = self.pattern, self.order[k + 1 :]
        return [any(j in p.around[i] or p.labels[i] == p.labels[j] for i in later) for j in self.order[: k + 1]]


def _steps(graph: CachedGraph, tasks: dict[int, Task], k: int, sigs: dict | None) -> DataFrame:
    """What the k-th step of each task needs: a row a task."""
    fan = graph.fan_out
    rows = []
    for t, task in sorted(tasks.items()):
        label = task.pattern.labels[task.order[k]]

        def usual(end, task=task, label=label):  # of so many neighbours
            starts, edges = fan.get((task.pattern.labels[task.order[end[0]]], end[1], label), (1, 0))
            return edges / starts, end

        ends = sorted(task.ends(k), key=usual)
        sig = sigs[D.signature(task.pattern, task.order[k])] if sigs is not None else -1
        rows.append((t, [p + 1 for p, _ in ends], [x for _, x in ends], label, task.wanted(k), sig))
    return lookup(graph.vertices.sparkSession, rows, "task int, at array<int>, labels array<double>, dst_label double, wanted array<boolean>, sig int")


def _kinds(tasks: dict[int, Task], k: int) -> set[tuple[float, float, float]]:
    """The kinds of edges that the k-th steps of the tasks look for."""
    return {(t.pattern.labels[t.order[p]], x, t.pattern.labels[t.order[k]]) for t in tasks.values() for p, x in t.ends(k)}


def _candidates(graph: CachedGraph, rows: DataFrame, n_ends: int, kinds: set, few: int | None) -> DataFrame:
    """rows (m, at, labels, dst_label and others) with c, neighbours that all n_ends ends have, none of them in m. kinds: of all edges looked for.
    few: where there is one end, so many at least of the least ids will do."""
    other = [c for c in rows.columns if c != "dst_label"]
    lists = graph.lists.where(of_kinds(kinds))
    first = graph.heads.where(of_kinds(kinds)) if few is not None and n_ends == 1 and few <= graph.head else lists

    def met(df: DataFrame, e: int, of: DataFrame, how: str = "inner") -> DataFrame:
        """df joined to rows by the vertex of end e; labels are compared afterwards, as tables are bucketed by vertex alone."""
        df = df.withColumns({"src": F.element_at("m", F.element_at("at", e + 1)), "edge": F.element_at("labels", e + 1)})
        of = of.select(F.col("src").alias("of_src"), F.col("label").alias("of_edge"), F.col("dst_label").alias("of_label"), *(c for c in of.columns if c in ("dsts", "dst")))
        same = (F.col("src") == F.col("of_src")) & (F.abs(F.col("edge") - F.col("of_edge")) == 0) & (F.abs(F.col("dst_label") - F.col("of_label")) == 0)
        return df.join(of, same & (F.col("x") == F.col("dst")) if "dst" in of.columns else same, how)

    out = met(rows, 0, first).select(*other, "dst_label", F.array_except("dsts", "m").alias("c"))
    for e in range(1, n_ends):
        light = met(out, e, lists.where(F.col("n") <= graph.hub) if graph.hubs else lists)
        both = light.select(*other, "dst_label", F.array_intersect("c", "dsts").alias("c"))
        if graph.hubs:  # of a hub's neighbours only those asked for
            asked = met(out, e, lists.where(F.col("n") > graph.hub), "left_semi").withColumn("x", F.explode("c"))
            found = met(asked, e, lists.where(F.col("n") > graph.hub).withColumn("dst", F.explode("dsts")).drop("dsts"), "left_semi")
            both = both.unionByName(found.select(*other, "dst_label", F.array("x").alias("c")))
        out = both
    return out.where(F.size("c") > 0)


def _shapes(tasks: dict[int, Task]) -> Iterable[tuple[tuple[int, ...], dict[int, Task]]]:
    out: dict[tuple[int, ...], dict[int, Task]] = {}
    for t, task in sorted(tasks.items()):
        out.setdefault(task.shape, {})[t] = task
    return sorted(out.items())


def _started(seeds: DataFrame, tasks: dict[int, Task]) -> DataFrame:
    return seeds.where(F.col("task").isin(list(tasks))).select("task", F.col("id").alias("seed"), F.array("id").alias("m"))


def _none(graph: CachedGraph, schema: str) -> DataFrame:
    return graph.vertices.sparkSession.createDataFrame([], schema)


def witnesses(graph: CachedGraph, tasks: dict[int, Task], seeds: DataFrame, ways: int = WAYS, least: bool = False) -> DataFrame:
    """task, seed and m, one whole embedding, for each seed (task, id) for which the bounded search finds one.

    From each partial embedding ways go on, the least vertices; of a seed's partial embeddings at most MOST do (with least: ways, the least ones
    in the task's order, which makes an embedding that is found the least of all). So a seed costs so much at most,
    whatever its neighbours' degrees; of a seed for which none is found nothing follows.
    """
    out = []
    for shape, few in _shapes(tasks):
        rows, held = _started(seeds, few), 1
        for k, n_ends in enumerate(shape, 1):
            last = k == len(shape)
            step = rows.join(_steps(graph, few, k, None), "task")
            found = _candidates(graph, step, n_ends, _kinds(few, k), (1 if last else ways) + k)
            if last:
                rows = found.groupBy("task", "seed").agg(F.min(F.concat("m", F.array(F.array_min("c")))).alias("m"))
                break
            rows = found.select("task", "seed", "m", F.explode(F.slice("c", 1, ways)).alias("x")).select("task", "seed", F.concat("m", F.array("x")).alias("m"))
            held *= ways
            if held > (ways if least else MOST):
                nth = F.row_number().over(W.partitionBy("task", "seed").orderBy("m"))
                held = ways if least else MOST
                rows = rows.withColumn("nth", nth).where(F.col("nth") <= held).drop("nth")
        out.append(rows)
    return reduce(DataFrame.unionByName, out) if out else _none(graph, "task int, seed long, m array<long>")


def valid(graph: CachedGraph, tasks: dict[int, Task], seeds: DataFrame, domains: DataFrame, sigs: dict) -> DataFrame:
    """task and id: the seeds that have an embedding at all. domains (sig, id): what the nodes may be mapped to.

    Vertices that no later node depends on are dropped, with the rows that then repeat, and a last node is only asked for whether there is
    one, so there is no relation of whole embeddings.
    """
    out = []
    for shape, few in _shapes(tasks):
        rows = _started(seeds, few)
        for k, n_ends in enumerate(shape, 1):
            step = rows.join(_steps(graph, few, k, sigs), "task")
            found = _candidates(graph, step, n_ends, _kinds(few, k), None)
            if k == len(shape):
                rows = found.select("task", "seed").distinct()
                break
            grown = found.withColumn("x", F.explode("c")).join(domains.select("sig", F.col("id").alias("x")), ["sig", "x"], "left_semi")
            m = F.zip_with(F.concat("m", F.array("x")), "wanted", lambda x, keep: F.when(keep, x))
            rows = grown.select("task", "seed", m.alias("m")).distinct()
        out.append(rows.select("task", F.col("seed").alias("id")))
    return reduce(DataFrame.unionByName, out) if out else _none(graph, "task int, id long")


def sought(graph: CachedGraph, tasks: dict[int, Task], seeds: DataFrame, domains: DataFrame, sigs: dict, own: DataFrame | None = None) -> DataFrame:
    """The seeds that have an embedding: those in own, what witnesses() found, and of the others those that the whole search leaves."""
    found = (own if own is not None else witnesses(graph, tasks, seeds)).select("task", F.col("seed").alias("id"))
    rest = seeds.join(found, ["task", "id"], "left_anti")
    return found.unionByName(valid(graph, tasks, rest, domains, sigs))


def signatures(patterns: Iterable[Pattern]) -> dict:
    """A number for each signature of the patterns' nodes."""
    out: dict[tuple, int] = {}
    for p in patterns:
        for i in range(p.n_nodes):
            out.setdefault(D.signature(p, i), len(out))
    return out


class Images:
    """The images of nodes of many patterns, found node by node; of nodes that an automorphism exchanges one is searched for.

    The search from a node's seeds gives a whole embedding for most of them. Its vertices are images of the other nodes, too, so when these
    come up, only candidates that are in no embedding so far are seeds. What is known is one table, task and id; a task is a pattern's orbit.
    """

    def __init__(self, graph: CachedGraph, patterns: dict[str, Pattern], domains: DataFrame | None = None, sigs: dict | None = None):
        self.graph, self.patterns, self.spark = graph, patterns, graph.vertices.sparkSession
        self.sigs = signatures(patterns.values()) if sigs is None else sigs
        self.paths: list[str] = []
        self.domains = self._kept(D.many_domains(graph, list(self.sigs))) if domains is None else domains
        self.task = {(c, i): t for t, (c, i) in enumerate((c, i) for c, p in sorted(patterns.items()) for i in sorted(set(p.orbits)))}
        self.known: DataFrame | None = None
        self.known_path = ""
        self.searched: dict[int, int] = {}

    def _kept(self, df: DataFrame) -> DataFrame:
        out, path = kept(df)
        self.paths.append(path)
        return out

    def seeds(self, todo: Iterable[tuple[str, int]], within: Column | None = None) -> DataFrame:
        """task and id: candidates of these nodes, the first of their orbits, that are not known to be images."""
        named = lookup(self.spark, [(self.task[c, i], self.sigs[D.signature(self.patterns[c], i)]) for c, i in sorted(todo)], "task int, sig int")
        out = self.domains.join(named, "sig").select("task", "id")
        out = out if within is None else out.where(within)
        return out if self.known is None else out.join(self.known, ["task", "id"], "left_anti")

    def state(self, todo: Iterable[tuple[str, int]], within: Column | None = None) -> tuple[dict[tuple[str, int], int], dict[tuple[str, int], int]]:
        """How many images are known of each node, and how many candidates of each in todo are left: one job."""
        rows = self.seeds(todo, within).groupBy("task").agg(F.count("*").alias("n")).withColumn("open", F.lit(True))
        if self.known is not None:
            own = self.known if within is None else self.known.where(within)
            rows = rows.unionByName(own.groupBy("task").agg(F.count("*").alias("n")).withColumn("open", F.lit(False)))
        node, known, left = {t: n for n, t in self.task.items()}, {}, {}
        for r in rows.collect():
            (left if r["open"] else known)[node[r["task"]]] = r["n"]
        return known, left

    def search(self, todo: Iterable[tuple[str, int]], within: Column | None = None) -> None:
        """Searches for the candidates that are left of these nodes, one of a pattern, and adds what is found, of whichever node. within: of ids for which it holds only."""
        todo = sorted(todo)
        tasks = {self.task[c, i]: Task.of(self.graph, self.patterns[c], i) for c, i in todo}
        seeds = self.seeds(todo, within)
        own, own_path = kept(witnesses(self.graph, tasks, seeds))
        places = [(self.task[c, j], p, self.task[c, self.patterns[c].orbits[i]]) for c, j in todo for p, i in enumerate(tasks[self.task[c, j]].order)]
        of = lookup(self.spark, places, "task int, place int, owner int")
        seen = own.select("task", F.posexplode("m").alias("place", "id")).join(of, ["task", "place"]).select(F.col("owner").alias("task"), "id")
        rest = seeds.join(own.select("task", F.col("seed").alias("id")), ["task", "id"], "left_anti")
        found = seen.unionByName(valid(self.graph, tasks, rest, self.domains, self.sigs))
        before, old = self.known, self.known_path
        self.known, self.known_path = kept((found if before is None else found.unionByName(before)).distinct())
        for path in (own_path, old):
            if path:
                remove(self.spark, path)

    def complete(self, orders: dict[str, list[int]], support: int = 0, within: Column | None = None, wave: int | None = None) -> dict[str, int]:
        """The least number of images over the nodes of each pattern, of whose orbits each is searched in this order; where it is below
        support, some number below it, as soon as known images and candidates left are too few.

        All patterns go side by side. Up to wave candidates all nodes are searched at once, which takes fewer jobs. Beyond, one node of each pattern is, and what
        this finds of other nodes is not searched for again; and with a support to reach, an eighth of the candidates (by hash of the id) goes first. Without support nothing need be
        counted, and nothing is returned.
        """
        wave = WAVE if wave is None else wave
        open_ = {c: list(dict.fromkeys(self.patterns[c].orbits[i] for i in cols)) for c, cols in orders.items()}
        out: dict[str, int] = {}
        done: set[tuple[str, int]] = set()
        while open_:
            known, left = self.state([(c, i) for c, cols in open_.items() for i in cols if (c, i) not in done], within)
            for c, cols in list(open_.items()):
                while cols and not left.get((c, cols[0])):
                    n = known.get((c, cols.pop(0)), 0)
                    out[c] = min(out.get(c, n), n)
                    if n < support:
                        cols.clear()
                bounds = [known.get((c, i), 0) + left.get((c, i), 0) for i in cols]
                if bounds and min(bounds) < support:
                    out[c] = min(bounds)
                    cols.clear()
                if not cols:
                    del open_[c]
            every = [(c, i) for c, cols in open_.items() for i in cols if left.get((c, i))]
            todo = every if sum(left[n] for n in every) <= wave else [(c, cols[0]) for c, cols in open_.items()]
            if not todo:
                continue
            size = sum(left[n] for n in todo)
            some = F.pmod(F.xxhash64("id"), F.lit(8)) == 0 if support and size > wave and not any(n in self.searched for n in todo) else None
            self.searched |= {n: left[n] for n in todo}
            done |= set() if some is not None else set(todo)
            self.search(todo, some if within is None else within if some is None else within & some)
            if not support and len(todo) == len(every):
                return {}
        return out

    def table(self, code: str) -> DataFrame:
        """col and id of one pattern, as far as searched."""
        p = self.patterns[code]
        cols = lookup(self.spark, [(self.task[code, o], i) for i, o in enumerate(p.orbits)], "task int, col int")
        return self.known.join(cols, "task").select("col", "id")

    def drop(self) -> None:
        for path in [*self.paths, self.known_path]:
            if path:
                remove(self.spark, path)
