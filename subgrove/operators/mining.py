"""Frequent subgraph mining, level by level: exact, by sampled supports, and exact after sampled ones."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pattern import Pattern, edge
from ..plans.graph import CachedGraph, Graph
from . import domains as D
from .edges import frequent_edges
from .sampling import Draw, intervals, verdict
from .support import star_centre, star_supports, supports

SCHEMA = "code string, n_nodes int, n_edges int, node_labels array<double>, edges array<struct<u:int,v:int,label:double>>, mni long, status string"
#: Edges a vertex above which sampling does not look at arcs first.
DENSE = 10


@dataclass(frozen=True)
class Config:
    """support: least MNI. max_edges and max_nodes bound patterns (None: no bound). max_candidates, off by default,
    evaluates only the first so many candidates of a level by code: patterns are then missed.

    min_samples, sample_size, every, z and seed are for sampled supports: every node's candidates are first drawn
    to min_samples, and of patterns that this leaves uncertain to sample_size; or, with every, those of ids divisible by it.
    """

    support: int
    max_edges: int | None = None
    max_nodes: int | None = None
    max_candidates: int | None = None
    min_samples: int = 60
    sample_size: int = 300
    every: int | None = None
    z: float = 2.58
    seed: int = 42


@dataclass(frozen=True)
class Prediction:
    """What sampling says of a pattern: the estimated support, exact, frequent, uncertain or infrequent, and the node to doubt first."""

    pattern: Pattern
    estimate: float
    status: str
    suspect: int


def _table(spark: SparkSession, found: dict[str, tuple[Pattern, int, str]]) -> DataFrame:
    rows = [(c, p.n_nodes, p.n_edges, list(p.labels), [{"u": u, "v": v, "label": x} for u, v, x in p.edges], int(n), status) for c, (p, n, status) in sorted(found.items())]
    return spark.createDataFrame(rows, SCHEMA)


def pattern_of(row) -> Pattern:
    """The pattern in a row of the table that mining returns."""
    return Pattern.of(row["node_labels"], [(e["u"], e["v"], e["label"]) for e in row["edges"]])


def _candidates(level: dict[str, Pattern], types: set, config: Config, known: set[str], more: dict[str, Pattern]) -> dict[str, Pattern]:
    """One edge more than the frequent patterns of a level, and those of more that have as many edges, if their every connected part is frequent."""
    out: dict[str, Pattern] = {}
    size = next(iter(level.values())).n_edges + 1
    extended = (q for p in level.values() for q in p.extensions(types))
    for q in (*(p for p in more.values() if p.n_edges == size), *extended):
        if (config.max_nodes is None or q.n_nodes <= config.max_nodes) and q.code not in out and q.parts().keys() <= known:
            out[q.code] = q
    return dict(sorted(out.items())[: config.max_candidates])


def _bounded(graph: Graph, candidates: dict[str, Pattern], support: int) -> dict[str, dict[int, int]]:
    """Candidates whose every domain has support vertices or more, with these sizes; all domains are counted in one job."""
    sigs: dict[tuple, int] = {}
    for p in candidates.values():
        for i in range(p.n_nodes):
            sigs.setdefault(D.signature(p, i), len(sigs))
    counts = {r["sig"]: r["n"] for r in D.many_domains(graph, list(sigs)).groupBy("sig").agg(F.count("*").alias("n")).collect()} if sigs else {}
    sizes = {c: {i: counts.get(sigs[D.signature(p, i)], 0) for i in range(p.n_nodes)} for c, p in candidates.items()}
    return {c: own for c, own in sizes.items() if min(own.values()) >= support}


def _levels(graph: Graph, config: Config, evaluate, more: dict[str, Pattern]) -> dict[str, tuple[Pattern, int, str]]:
    rows = frequent_edges(graph, config.support).collect()
    found = {p.code: (p, r["mni"], "exact") for r in rows for p in [edge(r["la"], r["lb"], r["el"])]}
    level = {c: p for c, (p, _, _) in found.items()}
    types = {(r["la"], r["lb"], r["el"]) for r in rows} | {(r["lb"], r["la"], r["el"]) for r in rows}
    size = 1
    while level and (config.max_edges is None or size < config.max_edges):
        candidates = _candidates(level, types, config, set(found), more)
        sizes = _bounded(graph, candidates, config.support)
        scored = evaluate({c: candidates[c] for c in sizes}, sizes) if sizes else {}
        found |= scored
        level, size = {c: p for c, (p, _, _) in scored.items()}, size + 1
    return found


def mine(graph: Graph, config: Config, predictions: dict[str, Prediction] | None = None) -> DataFrame:
    """All connected patterns of at least one edge with an exact MNI of config.support or more, with it.

    MNI cannot grow with a pattern, and each connected pattern has a connected part of one edge less, so
    extending frequent patterns by frequent edges misses none. A level's candidates are distinct by code,
    have frequent parts only, and large enough domains, before any embedding is searched. Patterns live on the
    driver; everything that depends on the graph's size is a plan, and a level is a few plans, however many
    candidates it has: one for all domains, one for all stars, and for all other patterns one search a node.

    predictions (of predict()) are candidates, too. Where one is exact it is not evaluated again; where it is
    infrequent, the node that failed is looked at first, and the others only if that one does not refute it.
    """
    predictions = predictions or {}
    with _tables(graph) as graph:
        return _mine(graph, config, predictions)


@contextmanager
def _tables(graph: Graph) -> Iterator[CachedGraph]:
    """The graph with its tables, which are removed in the end if they are not the caller's: what mining returns does not refer to them."""
    own = graph.cached()
    try:
        yield own
    finally:
        if own is not graph:
            own.drop()


def _mine(graph: CachedGraph, config: Config, predictions: dict[str, Prediction]) -> DataFrame:
    def exact(candidates: dict[str, Pattern], sizes: dict[str, dict[int, int]]):
        known = {c: int(predictions[c].estimate) for c in candidates if c in predictions and predictions[c].status == "exact"}
        rest = {c: p for c, p in candidates.items() if c not in known}
        suspects = {c: predictions[c].suspect for c in rest if c in predictions and predictions[c].status == "infrequent" and predictions[c].pattern == rest[c]}
        counts = known | supports(graph, rest, config.support, sizes, suspects)
        return {c: (p, counts[c], "exact") for c, p in candidates.items() if counts[c] >= config.support}

    return _table(graph.vertices.sparkSession, _levels(graph, config, exact, {c: p.pattern for c, p in predictions.items()}))


def predict(graph: Graph, config: Config, exact_stars: bool = False) -> dict[str, Prediction]:
    """Sampled supports of all candidates that come up when patterns are extended that their sample does not show infrequent.

    exact_stars: stars, which take one plan a level, are counted and not sampled.
    """
    with _tables(graph) as graph:
        return _predict(graph, config, exact_stars)


def _predict(graph: CachedGraph, config: Config, exact_stars: bool) -> dict[str, Prediction]:
    out: dict[str, Prediction] = {}
    first = Draw(config.min_samples, config.every, config.z, config.seed)
    arcs = None

    def sampled(candidates: dict[str, Pattern], sizes):
        nonlocal arcs
        if arcs is None:
            arcs = graph.density() <= DENSE
        known = star_supports(graph, {c: p for c, p in candidates.items() if star_centre(p) is not None}) if exact_stars else {}
        for c, n in known.items():
            out[c] = Prediction(candidates[c], float(n), "exact", 0)
        draws = [first] if config.every or config.min_samples >= config.sample_size else [first, replace(first, size=config.sample_size)]
        for c, columns in intervals(graph, {c: p for c, p in candidates.items() if c not in known}, config.support, draws, arcs).items():
            out[c] = Prediction(candidates[c], *verdict(columns))
        return {c: (p, int(out[c].estimate), out[c].status) for c, p in candidates.items() if out[c].status != "infrequent" and (c not in known or known[c] >= config.support)}

    found = _levels(graph, config, sampled, {})
    return out | {c: Prediction(p, n, "exact", 0) for c, (p, n, _) in found.items() if p.n_edges == 1}


def mine_approx(graph: Graph, config: Config) -> DataFrame:
    """As mine(), by sampled supports: patterns whose sample does not show them infrequent, with the estimate
    rounded down as mni and the verdict as status (exact where all domains were drawn whole)."""
    found = {c: (p.pattern, int(p.estimate), p.status) for c, p in predict(graph, config).items() if p.status != "infrequent"}
    return _table(graph.vertices.sparkSession, found)


def mine_two_phase(graph: Graph, config: Config) -> DataFrame:
    """mine() with the predictions of sampling: the same patterns and supports, by fewer searches. Only patterns that need a search are sampled."""
    with _tables(graph) as graph:
        return mine(graph, config, predict(graph, config, exact_stars=True))


def top_patterns(patterns: DataFrame, k: int) -> DataFrame:
    """The k patterns of largest support, ties by code."""
    return patterns.orderBy(F.desc("mni"), "code").limit(k)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Patterns of either set, one row a code; the larger mni is kept, of equal ones an exact one."""
    best = a.unionByName(b).groupBy("code").agg(F.max_by(F.struct("n_nodes", "n_edges", "node_labels", "edges", "mni", "status"), F.struct("mni", F.when(F.col("status") == "exact", 1).otherwise(0), "status")).alias("p"))
    return best.select("code", "p.*")


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("code"), "code", "left_anti")


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("code"), "code", "left_semi")


def result_lines(patterns: DataFrame) -> DataFrame:
    """The result as text, rows (value, at) to be ordered by at: how many patterns, then, for each number of edges, how many,
    and each of them with its number, support and .lg lines. Numbers follow support, then code."""
    rows = sorted(patterns.collect(), key=lambda r: (r["n_edges"], -r["mni"], r["code"]))  # patterns are few: they came from the driver
    lines, size = [f"# patterns {len(rows)}"], None
    for k, r in enumerate(rows):
        if r["n_edges"] != size:
            size = r["n_edges"]
            lines.append(f"# edges {size}: {sum(x['n_edges'] == size for x in rows)}")
        head, *rest = pattern_of(r).to_lg().rstrip("\n").split("\n")
        lines += [f"# t {k + 1}", f"# support {r['mni']} {r['status']}", *rest]
    return patterns.sparkSession.createDataFrame(list(zip(lines, range(len(lines)), strict=True)), "value string, at long")


def write_result(patterns: DataFrame, path: str) -> None:
    result_lines(patterns).orderBy("at").select("value").coalesce(1).write.text(path)


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """The patterns of a text that write_result() wrote."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).orderBy("value").collect())
    found = {}
    for part in text.split("# t ")[1:]:
        head, said, *lines = part.split("\n")
        body = "\n".join(x for x in lines if x[:1] in ("v", "e"))
        p = Pattern.from_lg(body)
        found[p.code] = (p, int(said.split()[2]), said.split()[3])
    return _table(spark, found)
