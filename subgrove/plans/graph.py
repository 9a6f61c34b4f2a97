"""The data graph: one undirected labelled graph as two tables."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import dealt, exists, forget, kept, kept_by, remove


def of_kinds(kinds: Iterable[tuple[float, float, float]]) -> Column:
    """Whether a row's labels (src_label, label, dst_label) are among so many kinds: a test that scans can skip files' parts by. Of many kinds each label is tested by itself."""
    kinds, names = sorted(set(kinds)), ("src_label", "label", "dst_label")
    if len(kinds) > 40:
        return reduce(lambda a, b: a & b, (F.col(c).isin(sorted({k[i] for k in kinds})) for i, c in enumerate(names)))
    return reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (F.col(c) == x for c, x in zip(names, k, strict=True))) for k in kinds), F.lit(False))


@dataclass(frozen=True)
class Graph:
    """vertices (id, label) with unique ids; edges (src < dst, label) with unique pairs and no self-loop. ends: the edges with src_label and dst_label, where these are known."""

    vertices: DataFrame
    edges: DataFrame
    ends: DataFrame | None = None

    @staticmethod
    def clean(vertices: DataFrame, edges: DataFrame, order: str | None = None, kinds: Iterable[tuple[float, float, float]] | None = None) -> Graph:
        """A graph from rows in which ids, pairs and directions may repeat.

        Of repeated vertices or pairs the first by the column order wins (without one, the least label).
        Self-loops and edges to unknown vertices are dropped. One aggregation each, which combines in the map
        tasks, then two semi-joins.

        kinds (label, edge label, label at the other end, both ways round): only edges of these kinds and vertices of their labels, all that patterns of such
        edges can be mapped to. Then edges are joined to the labels at their ends first, so only those of the kinds' labels are dealt out a second time;
        which of repeated rows wins is the same, as it is settled before edge labels are compared.
        """
        first = lambda: F.min_by("label", order).alias("label") if order else F.min("label").alias("label")
        v = vertices.groupBy(F.col("id").cast("long").alias("id")).agg(first()).withColumn("label", F.col("label").cast("double"))
        pairs = edges.where("src <> dst").withColumns({"a": F.least("src", "dst").cast("long"), "b": F.greatest("src", "dst").cast("long")})
        if kinds is not None:
            kinds = set(kinds)
            v = v.where(F.col("label").isin(sorted({x for k in kinds for x in (k[0], k[2])})))
            at = lambda end: v.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
            both = reduce(lambda p, q: p | q, ((F.col("a_label") == x) & (F.col("b_label") == y) for x, y in sorted({(k[0], k[2]) for k in kinds})), F.lit(False))
            met = pairs.join(at("a"), "a").join(at("b"), "b").where(both).groupBy("b", "a", "a_label", "b_label").agg(first())
            ends = met.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("label").cast("double").alias("label"), F.col("a_label").alias("src_label"), F.col("b_label").alias("dst_label")).where(of_kinds(kinds))
            return Graph(v, ends.select("src", "dst", "label"), ends)
        e = pairs.groupBy("a", "b").agg(first()).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("label").cast("double").alias("label"))
        ids = v.select("id")
        e = e.join(ids, e["src"] == ids["id"], "left_semi").join(ids, F.col("dst") == ids["id"], "left_semi")
        return Graph(v, e)

    @cached_property
    def adj(self) -> DataFrame:
        """Both directions of each edge with the labels at its ends, so that label filters reach the scan."""
        v = self.vertices
        labelled = self.ends if self.ends is not None else self.edges.join(v.select(F.col("id").alias("src"), F.col("label").alias("src_label")), "src").join(v.select(F.col("id").alias("dst"), F.col("label").alias("dst_label")), "dst")
        columns = ["src", "dst", "label", "src_label", "dst_label"]
        back = labelled.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label", F.col("dst_label").alias("src_label"), F.col("src_label").alias("dst_label"))
        return labelled.select(*columns).unionByName(back)

    @cached_property
    def kinds(self) -> DataFrame:
        """How many edges of each kind (label and label at the other end) each vertex has: src, src_label, label, dst_label, n."""
        return self.adj.groupBy("src", "src_label", "label", "dst_label").agg(F.count("*").alias("n"))

    def cached(self) -> Graph:
        """The same graph from written tables, for the many plans that refer to it: each is then a scan. A table is
        written when it is first asked for."""
        return self if isinstance(self, CachedGraph) else CachedGraph(self)

    def density(self) -> float:
        """Edges a vertex."""
        return self.edges.count() / max(1, self.vertices.count())

    def by_id(self, ids: DataFrame) -> DataFrame:
        """id and label of the vertices in ids (id); null where there is none."""
        return ids.select("id").join(self.vertices, "id", "left")

    def by_label(self, label: float) -> DataFrame:
        return self.vertices.where(F.col("label") == float(label)).select("id")

    def counts(self) -> DataFrame:
        """One row: n_vertices, n_edges."""
        return self.vertices.agg(F.count("*").alias("n_vertices")).crossJoin(self.edges.agg(F.count("*").alias("n_edges")))

    def degrees(self) -> DataFrame:
        """id, label and degree of every vertex, isolated ones included."""
        deg = self.adj.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
        return self.vertices.join(deg, "id", "left").select("id", "label", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    def label_histogram(self) -> DataFrame:
        return self.vertices.groupBy("label").agg(F.count("*").alias("n"))

    def frequent_labels(self, least: int) -> Graph:
        """Only vertices whose label at least so many vertices have, and the edges among them."""
        often = self.label_histogram().where(F.col("n") >= least).select("label")
        return self._among(self.vertices.join(often, "label", "left_semi").select("id", "label"))

    def _among(self, v: DataFrame) -> Graph:
        ids = v.select("id")
        e = self.edges.join(ids, self.edges["src"] == ids["id"], "left_semi").join(ids, F.col("dst") == ids["id"], "left_semi")
        return Graph(v, e)

    def without_vertices(self, ids: DataFrame) -> Graph:
        return self._among(self.vertices.join(ids.select("id"), "id", "left_anti"))

    def without_edges(self, pairs: DataFrame, drop_isolated: bool = True) -> Graph:
        """Less the edges (src, dst, either way round), and less vertices that lose their last edge by it."""
        gone = pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
        e = self.edges.join(gone, ["src", "dst"], "left_anti")
        if not drop_isolated:
            return Graph(self.vertices, e)
        ends = lambda x: x.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        lost = ends(self.edges.join(gone, ["src", "dst"], "left_semi")).join(ends(e), "id", "left_anti")
        return Graph(self.vertices.join(lost, "id", "left_anti"), e)

    def edge_label(self, pairs: DataFrame) -> DataFrame:
        """src, dst and the label of the edge between them; null where there is none."""
        known = self.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "label")
        return pairs.join(known, (F.least("src", "dst") == F.col("a")) & (F.greatest("src", "dst") == F.col("b")), "left").select("src", "dst", "label")

    def neighbours(self) -> DataFrame:
        """id and its edges as a sorted list; a list per vertex is as long as its degree, so for output only."""
        return self.adj.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct("dst", "label"))).alias("edges"))

    def components(self) -> DataFrame:
        """id and the least id that it is connected with, by repeated minima over neighbours and their roots."""
        roots, links = self.vertices.select("id", F.col("id").alias("root")), self.adj.select("src", "dst")
        spark, path = self.vertices.sparkSession, None
        while True:
            low = links.join(roots, links["dst"] == roots["id"]).groupBy("src").agg(F.min("root").alias("low"))
            hop = roots.join(low, roots["id"] == low["src"], "left").select("id", "root", F.least("root", F.coalesce("low", "root")).alias("new"))
            parent = hop.select(F.col("id").alias("p"), F.col("new").alias("up"))
            jumped = hop.join(parent, hop["new"] == parent["p"]).select("id", "root", F.least("new", "up").alias("new"))
            before = path
            jumped, path = kept(jumped)
            if before:
                remove(spark, before)
            moved = jumped.where("root <> new").limit(1).count()
            roots = jumped.select("id", F.col("new").alias("root"))
            if not moved:
                return roots


#: Neighbours of one kind above which a vertex is a hub: its list is cut.
HUB = 1024
#: Of a hub's neighbours of one kind, so many of least id are also a list of their own.
HEAD = 64


class CachedGraph(Graph):
    """A graph whose vertices and neighbour lists are tables of their own, written when first asked for.

    lists is bucketed by src, and adjacency and kinds are views of it, so what is joined to any of them by vertex is dealt to
    its buckets, and the table itself is not dealt out again.
    """

    def __init__(self, base: Graph, hub: int = HUB, head: int = HEAD):
        self.__dict__.update(base=base, paths=[], names=[], hub=hub, head=head)

    def _kept(self, df: DataFrame) -> DataFrame:
        out, path = kept(df)
        self.paths.append(path)
        return out

    @cached_property
    def vertices(self) -> DataFrame:
        return self._kept(self.base.vertices)

    @cached_property
    def lists(self) -> DataFrame:
        """src, src_label, label, dst_label, n, part, dsts: the neighbours of each vertex by kind, ascending, n of them, sorted by labels
        within each bucket, so that filters on them skip parts of files. Up to hub neighbours are one list, part 0; a hub's are cut by hash into parts 1, 2, ... of about hub neighbours each."""
        key, order = ["src", "src_label", "label", "dst_label"], ["src_label", "label", "dst_label", "src"]
        ends, ends_path = (None, "") if self.base.ends is None else kept(self.base.ends)  # its shuffles are gone before lists are made
        rows = dealt(Graph(self.vertices, self.base.edges, ends).adj.select(*key, "dst"), ["src"])
        sized = rows.withColumn("n", F.count("*").over(W.partitionBy(*key)))
        part = F.when(F.col("n") <= self.hub, 0).otherwise(F.pmod(F.xxhash64("dst"), F.ceil(F.col("n") / self.hub)) + 1).cast("int")
        listed = sized.withColumn("part", part).groupBy(*key, "n", "part").agg(F.sort_array(F.collect_list("dst")).alias("dsts"))
        out, path, name = kept_by(listed, ["src"], order)
        if ends_path:
            remove(self.base.vertices.sparkSession, ends_path)
        self.paths.append(path)
        self.names.append(name)
        return out

    @cached_property
    def hubs(self) -> bool:
        """Whether any vertex is a hub."""
        return not self.lists.where(F.col("n") > self.hub).isEmpty()

    @cached_property
    def heads(self) -> DataFrame:
        """As lists, but of a hub only its neighbours of least id."""
        light = self.lists.where(F.col("n") <= self.hub)
        if not self.hubs:
            return light
        key = ["src", "src_label", "label", "dst_label", "n"]
        first = self.lists.where(F.col("n") > self.hub).select(*key, F.explode(F.slice("dsts", 1, self.head)).alias("dst"))
        own = first.groupBy(*key).agg(F.slice(F.sort_array(F.collect_list("dst")), 1, self.head).alias("dsts"))
        return light.unionByName(self._kept(own.select(*key, F.lit(0).alias("part"), "dsts")))

    @property
    def adj(self) -> DataFrame:
        return self.lists.select("src", F.explode("dsts").alias("dst"), "label", "src_label", "dst_label")

    @property
    def edges(self) -> DataFrame:
        return self.adj.where("src < dst").select("src", "dst", "label") if "lists" in self.__dict__ else self.base.edges

    @property
    def kinds(self) -> DataFrame:
        rows = self.lists.select("src", "src_label", "label", "dst_label", "n")
        return rows.distinct() if self.hubs else rows

    @cached_property
    def fan_out(self) -> dict[tuple[float, float, float], tuple[int, int]]:
        """Of each kind of edge (label, edge label, label at the other end), how many vertices have such edges, and how many edges there are: a row for each combination of labels."""
        rows = self.kinds.groupBy("src_label", "label", "dst_label").agg(F.count("*").alias("starts"), F.sum("n").alias("edges")).collect()
        return {(r["src_label"], r["label"], r["dst_label"]): (r["starts"], r["edges"]) for r in rows}

    @property
    def label_sizes(self) -> dict[float, int]:
        """About how many vertices of each label have edges."""
        out: dict[float, int] = {}
        for (a, _, _), (starts, _) in self.fan_out.items():
            out[a] = max(out.get(a, 0), starts)
        return out

    def drop(self) -> None:
        """Removes its tables; of what refers to them nothing can be read any more."""
        spark = self.base.vertices.sparkSession
        for name in self.names:
            forget(spark, name)
        for path in self.paths:
            remove(spark, path)
        self.paths.clear()
        self.names.clear()
        for name in ("vertices", "lists", "hubs", "heads", "fan_out"):
            self.__dict__.pop(name, None)

    def alive(self) -> bool:
        """Whether its tables are still there."""
        spark = self.base.vertices.sparkSession
        return all(exists(spark, p) for p in self.paths)
