"""Queries of the graph engine over the commerce graph, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pattern import Pattern, path, star
from ..operators import domains as D
from ..operators import edges as E
from ..operators import mining as M
from ..operators import sampling as SA
from ..operators import support as SU
from ..operators.embeddings import embeddings
from ..sources import commerce as C
from ..sources import lg
from .graph import CachedGraph, Graph
from .shared import changed, remove, shared_folder, stored

CUSTOMER, ORDER, PART, SUPPLIER = 101.0, 201.0, 301.0, 400.0
PATH = path([CUSTOMER, ORDER, PART, SUPPLIER], [1, 2, 4])
UNIQUE_TREE = Pattern.of([ORDER, CUSTOMER, PART, SUPPLIER], [(0, 1, 1), (0, 2, 2), (0, 3, 3)])
TRIANGLE = Pattern.of([ORDER, PART, SUPPLIER], [(0, 1, 2), (0, 2, 3), (1, 2, 4)])
FORK = star(CUSTOMER, [ORDER, ORDER], [1, 1])
STAR3 = star(CUSTOMER, [ORDER, ORDER, 202.0], [1, 1, 1])
BENT = path([ORDER, CUSTOMER, ORDER, PART], [1, 1, 2])
SQUARE = Pattern.of([ORDER, PART, 202.0, SUPPLIER], [(0, 1, 2), (1, 2, 2), (2, 3, 3), (0, 3, 3)])
WIDE = (CUSTOMER, ORDER, 202.0, PART)
CASES = {"path": PATH, "tree": UNIQUE_TREE, "triangle": TRIANGLE, "fork": FORK, "star3": STAR3, "bent": BENT}


_GRAPHS: dict[tuple[str, str, bool | frozenset], tuple[tuple, CachedGraph]] = {}


def _graph(spark: SparkSession, sf_dir: str, forest: bool = False, pattern: Pattern | None = None) -> CachedGraph:
    """The commerce graph (or its customers and orders only), whose tables are written once a session, when first asked for, and anew
    when the tables it comes from have been written anew.

    pattern: unless the whole graph's lists are there already, the graph of the pattern's kinds of edges alone, so that only these are written.
    """
    if pattern is not None and pattern.n_edges and "lists" not in _graph(spark, sf_dir).__dict__:
        return _known(spark, sf_dir, pattern.kinds, lambda: C.commerce(spark, sf_dir, pattern.kinds))
    return _known(spark, sf_dir, forest, lambda: (C.forest if forest else C.commerce)(spark, sf_dir))


def _known(spark: SparkSession, sf_dir: str, which: bool | frozenset, made: Callable[[], Graph]) -> CachedGraph:
    key, written = (spark.sparkContext.applicationId, sf_dir, which), tuple(changed(spark, f"{sf_dir}/{t}.parquet") for t in C.TABLES)
    known = _GRAPHS.get(key)
    if known is None or known[0] != written or not known[1].alive():
        if known:
            known[1].drop()
        _GRAPHS[key] = (written, made().cached())
    return _GRAPHS[key][1]


def drop_graphs() -> None:
    """Removes the tables of all graphs of the queries."""
    for _, graph in _GRAPHS.values():
        graph.drop()
    _GRAPHS.clear()


def _share(spark: SparkSession, sf_dir: str, hundredths: int) -> int:
    """Supports follow the size of the data: so many hundredths of the customers."""
    return spark.read.parquet(f"{sf_dir}/customer.parquet").count() * hundredths // 100


def graph_vertices(spark, sf_dir):
    return _graph(spark, sf_dir).vertices


def graph_edges(spark, sf_dir):
    return _graph(spark, sf_dir).edges.select("src", "dst", F.col("label").alias("el"))


def label_histogram(spark, sf_dir):
    return _graph(spark, sf_dir).label_histogram()


def frequent_labels(spark, sf_dir):
    return _graph(spark, sf_dir).frequent_labels(_share(spark, sf_dir, 20)).counts()


def degree_by_label(spark, sf_dir):
    return _graph(spark, sf_dir).degrees().groupBy("label").agg(F.count("*").alias("n"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.sum("degree").alias("sum_degree"))


def _sums(g: Graph) -> DataFrame:
    v = g.vertices.agg(F.count("*").alias("n_vertices"), F.sum("id").alias("sum_ids"), F.sum("label").alias("sum_labels"))
    return v.crossJoin(g.edges.agg(F.count("*").alias("n_edges"), F.sum(F.col("src") % 1000 + F.col("dst") % 1000).alias("sum_ends")))


def lg_roundtrip_counts(spark, sf_dir):
    lines = lg.lg_lines(C.forest(spark, sf_dir)).select("value", F.struct("kind", "a", "b").alias("at"))
    return _sums(Graph.clean(*lg.parse_lg(lines), order="at"))


def lg_file_roundtrip(spark, sf_dir):
    """Through a .lg file."""
    path = f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}.lg"
    lg.write_lg(C.forest(spark, sf_dir), path)
    out = stored(_sums(lg.read_lg(spark, path)))
    remove(spark, path)
    return out


def lg_text_graph(spark, sf_dir):
    """From lines of text: suppliers in a row, each vertex and pair twice with another label (the first line wins), self-loops, and an edge to no vertex."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"), "s_nationkey")
    line = lambda n, *parts: F.struct(F.concat_ws(" ", *parts).alias("value"), F.struct(F.lit(n), F.col("k")).alias("at"))
    v, e, after = F.lit("v"), F.lit("e"), F.col("k") + 1
    lines = s.select(F.explode(F.array(
        line(0, v, "k", "s_nationkey"), line(1, v, "k", F.lit(99)), line(2, e, "k", after, F.lit(1)), line(3, e, after, "k", F.lit(7)), line(4, e, "k", "k", F.lit(1)),
    )).alias("x")).select("x.*")
    return Graph.clean(*lg.parse_lg(lines), order="at").adj


def table_graph_counts(spark, sf_dir):
    """Through Parquet tables of vertices and edges."""
    path, g = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", C.forest(spark, sf_dir)
    g.vertices.write.parquet(f"{path}/vertices")
    g.edges.write.parquet(f"{path}/edges")
    out = stored(_sums(lg.read_tables(spark, f"{path}/vertices", f"{path}/edges")))
    remove(spark, path)
    return out


def node_dump(spark, sf_dir):
    """Each customer's edges as a line."""
    rows = _graph(spark, sf_dir, forest=True).neighbours().where("id < 2000000000")
    return rows.select("id", F.concat_ws(" ", F.transform("edges", lambda e: e["dst"].cast("string"))).alias("edges"))


def vertex_lookup(spark, sf_dir):
    """Vertices by id, and how many there are of a label."""
    g = _graph(spark, sf_dir)
    ids = spark.read.parquet(f"{sf_dir}/part.parquet").select((3_000_000_001 + F.col("p_partkey") * 2).alias("id"))
    return g.by_id(ids).crossJoin(g.by_label(SUPPLIER).agg(F.count("*").alias("n_suppliers")))


def label_presence(spark, sf_dir):
    """Whether there are enough vertices of each label for a pattern."""
    have = {r["label"]: r["n"] for r in _graph(spark, sf_dir).label_histogram().collect()}
    rows = [(k, p.held_by(have)) for k, p in {**CASES, "stranger": path([CUSTOMER, 999.0], [1])}.items()]
    return spark.createDataFrame(rows, "name string, present boolean")


def edge_pattern_mni(spark, sf_dir):
    return E.edge_patterns(_graph(spark, sf_dir))


def frequent_edges(spark, sf_dir):
    return E.frequent_edges(_graph(spark, sf_dir), _share(spark, sf_dir, 17))


def two_edge_candidates(spark, sf_dir):
    rows = []
    for p in E.two_edge_candidates(frequent_edges(spark, sf_dir)).values():
        centre = next(i for i in range(3) if len(p.around[i]) == 2)
        (e1, l1), (e2, l2) = sorted((x, p.labels[j]) for j, x in p.around[centre].items())
        rows.append((p.labels[centre], e1, l1, e2, l2))
    return spark.createDataFrame(rows, "centre double, e1 double, l1 double, e2 double, l2 double")


def domain_label_degree(spark, sf_dir):
    return D.degree_domains(_graph(spark, sf_dir), TRIANGLE).groupBy("col").agg(F.count("*").alias("n"))


def _sizes(found):
    return D.as_table(found).groupBy("col").agg(F.count("*").alias("n"), F.sum(F.col("id") % 1000).alias("sum_ids"))


def ac3_domains_path(spark, sf_dir):
    return _sizes(D.ac3_domains(_graph(spark, sf_dir), PATH))


def ac3_domains_triangle(spark, sf_dir):
    return _sizes(D.ac3_domains(_graph(spark, sf_dir), TRIANGLE))


def embeddings_path(spark, sf_dir):
    return embeddings(_graph(spark, sf_dir), PATH).agg(F.count("*").alias("n"), F.sum(F.col("n0") % 1000 + F.col("n3") % 1000).alias("sum_ends"))


def embeddings_triangle(spark, sf_dir):
    return embeddings(_graph(spark, sf_dir), TRIANGLE).agg(F.count("*").alias("n"), F.sum(F.col("n1") % 1000).alias("sum_parts"))


def _mni(pattern):
    return lambda spark, sf_dir: SU.mni(_graph(spark, sf_dir, pattern=pattern), pattern)


def mni_table_bent(spark, sf_dir):
    return SU.mni_table(_graph(spark, sf_dir), BENT)


def mni_partitioned(spark, sf_dir):
    return SU.mni_partitioned(_graph(spark, sf_dir), FORK, 4)


def occurrence_dump(spark, sf_dir):
    """The vertices that each node of a pattern is mapped to."""
    return SU.images(_graph(spark, sf_dir, pattern=TRIANGLE), TRIANGLE)


def first_embeddings(spark, sf_dir):
    """For each supplier, one triangle."""
    g = _graph(spark, sf_dir)
    return SU.first_embedding(g, TRIANGLE, 2, g.by_label(SUPPLIER))


def refuted_pattern(spark, sf_dir):
    """The node whose images refute a pattern at a support that no pattern with suppliers has, and at one that the triangle has."""
    g, n = _graph(spark, sf_dir), _share(spark, sf_dir, 100)
    rows = [(n, SU.refuted_by(g, TRIANGLE, n)), (1, SU.refuted_by(g, TRIANGLE, 1))]
    return spark.createDataFrame(rows, "support long, col int")


def one_column_refute(spark, sf_dir):
    n = SU.column_images(_graph(spark, sf_dir), TRIANGLE, 2)
    return n.agg(F.count("*").alias("n"), (F.count("*") < _share(spark, sf_dir, 17)).alias("refuted"))


def support_sample_frac(spark, sf_dir):
    return SA.sampled_fraction(_graph(spark, sf_dir), FORK, 3)


def support_ci(spark, sf_dir):
    return SA.support_interval(_graph(spark, sf_dir), FORK, _share(spark, sf_dir, 11), SA.Draw(every=3)).select("col", "domain", "n", "valid", F.round("estimate", 6).alias("estimate"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "verdict")


def support_ci_hash(spark, sf_dir):
    """As support_ci, from about 60 candidates of each node, drawn by hash."""
    found = SA.support_interval(_graph(spark, sf_dir), FORK, _share(spark, sf_dir, 11), SA.Draw(size=60))
    return found.select("col", "domain", "n", "valid", F.round("estimate", 6).alias("estimate"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "verdict")


def support_ci_bent(spark, sf_dir):
    """Sampled supports of a path that needs a search."""
    return SA.drawn(_graph(spark, sf_dir), {"": BENT}, SA.Draw(size=40)).select("col", "domain", "n", "valid")


def edge_label_lookup(spark, sf_dir):
    g = _graph(spark, sf_dir)
    pairs = spark.read.parquet(f"{sf_dir}/orders.parquet").select((2_000_000_000 + F.col("o_orderkey")).alias("src"), (1_000_000_001 + F.col("o_custkey") % 7).alias("dst"))
    return g.edge_label(pairs).select("src", "dst", F.col("label").alias("el"))


def edge_removal_isolated(spark, sf_dir):
    g = _graph(spark, sf_dir, forest=True)
    left = g.without_edges(g.edges.where("src % 5 = 0"))
    return left.counts()


def vertex_removal(spark, sf_dir):
    left = (g := _graph(spark, sf_dir)).without_vertices(g.vertices.where("label = 400"))
    return left.counts()


def neighbourhood_containment(spark, sf_dir):
    found = D.domains(_graph(spark, sf_dir), STAR3)[0]
    return found.agg(F.count("*").alias("n"), F.sum(F.col("id") % 1000).alias("sum_ids"))


def connected_components(spark, sf_dir):
    return _graph(spark, sf_dir, forest=True).components()


def pattern_canonical_codes(spark, sf_dir):
    """The codes of all patterns of up to two edges that are mined from the forest."""
    return _mined(spark, sf_dir, 2).select("code", "n_nodes", "n_edges", "mni")


def _rows(patterns: DataFrame, nodes: int = 3) -> DataFrame:
    """Patterns of the forest by their labels in order: there the centre is the customer, and has the least."""
    labels = F.sort_array("node_labels")
    return patterns.select("n_edges", *(F.get(labels, F.lit(i)).alias(f"l{i + 1}") for i in range(nodes)), "mni")


def _config(spark, sf_dir, edges, **more):
    return M.Config(_share(spark, sf_dir, 11), max_edges=edges, **more)


def _mined(spark, sf_dir, edges):
    return M.mine(_graph(spark, sf_dir, forest=True), _config(spark, sf_dir, edges))


def mine_forest_k2(spark, sf_dir):
    return _rows(_mined(spark, sf_dir, 2))


def mine_forest_k3(spark, sf_dir):
    return _rows(_mined(spark, sf_dir, 3), 4)


def mine_approx_k2(spark, sf_dir):
    """Supports by every third candidate."""
    found = M.mine_approx(_graph(spark, sf_dir, forest=True), _config(spark, sf_dir, 2, every=3))
    return _rows(found.withColumn("mni", F.struct("mni", "status"))).select("n_edges", "l1", "l2", "l3", "mni.mni", "mni.status")


def mine_two_phase_k3(spark, sf_dir):
    """Sampled, then exact: the same patterns as mining exactly."""
    return _rows(M.mine_two_phase(_graph(spark, sf_dir, forest=True), _config(spark, sf_dir, 3)), 4)


def mine_cyclic(spark, sf_dir):
    """Patterns of up to three nodes, triangles too, among the orders and parts of one label and the suppliers."""
    g = _graph(spark, sf_dir)
    small = g.without_vertices(g.vertices.where(~F.col("label").isin(ORDER, PART, SUPPLIER)))
    return _rows(M.mine(small, M.Config(_share(spark, sf_dir, 4), max_edges=3, max_nodes=3))).groupBy("n_edges", "l1", "l2", "l3").agg(F.count("*").alias("n"), F.sum("mni").alias("sum_mni"))


def mine_paths_k3(spark, sf_dir):
    """Patterns of up to three edges, paths and stars, among the customers, orders and parts of four labels."""
    g = _graph(spark, sf_dir)
    small = g.without_vertices(g.vertices.where(~F.col("label").isin(*WIDE)))
    found = _rows(M.mine(small, M.Config(_share(spark, sf_dir, 9), max_edges=3)), 4)
    return found.groupBy("n_edges", "l1", "l2", "l3", "l4").agg(F.count("*").alias("n"), F.sum("mni").alias("sum_mni"))


def result_roundtrip(spark, sf_dir):
    """The mined patterns as numbered .lg text and back: how many of each size, and their supports."""
    path = f"{shared_folder(spark)}/result-{uuid.uuid4().hex}"
    M.write_result(_mined(spark, sf_dir, 2), path)
    found = M.read_result(spark, path)
    remove(spark, path)
    return found.groupBy("n_edges").agg(F.count("*").alias("n"), F.sum("mni").alias("sum_mni"))


def top_patterns(spark, sf_dir):
    patterns = _mined(spark, sf_dir, 2)
    labels = F.sort_array("node_labels")
    rows = patterns.withColumn("code", F.array_join(F.transform(labels, lambda x: x.cast("int").cast("string")), "-"))
    return M.top_patterns(rows.select("code", "mni"), 5)


def pattern_set_ops(spark, sf_dir):
    two = _mined(spark, sf_dir, 2)
    one, big = two.where("n_edges = 1"), two.where(F.col("mni") >= _share(spark, sf_dir, 17))
    named = {"union": M.union(one, big), "minus": M.minus(two, one), "common": M.common(one, big)}
    return reduce(DataFrame.unionByName, [d.agg(F.count("*").alias("n"), F.sum("mni").alias("sum_mni")).select(F.lit(k).alias("op"), "n", F.coalesce("sum_mni", F.lit(0)).alias("sum_mni")) for k, d in named.items()])


def cost_quartiles(spark, sf_dir):
    return SA.quartiles(_graph(spark, sf_dir).degrees(), "degree", "label")


QUERIES = {
    **{f.__name__: f for f in (graph_vertices, graph_edges, label_histogram, frequent_labels, degree_by_label, lg_roundtrip_counts, lg_file_roundtrip, lg_text_graph, table_graph_counts, node_dump, vertex_lookup, label_presence, edge_pattern_mni, frequent_edges, two_edge_candidates, domain_label_degree, ac3_domains_path, ac3_domains_triangle, embeddings_path, embeddings_triangle)},
    "mni_path": _mni(PATH),
    "mni_unique_tree": _mni(UNIQUE_TREE),
    "mni_triangle": _mni(TRIANGLE),
    "mni_fork_same_label": _mni(FORK),
    "mni_star3": _mni(STAR3),
    "mni_square": _mni(SQUARE),
    **{f.__name__: f for f in (mni_table_bent, mni_partitioned, occurrence_dump, first_embeddings, refuted_pattern, one_column_refute, support_sample_frac, support_ci, support_ci_hash, support_ci_bent, edge_label_lookup, edge_removal_isolated, vertex_removal, neighbourhood_containment, connected_components, pattern_canonical_codes, mine_forest_k2, mine_forest_k3, mine_approx_k2, mine_two_phase_k3, mine_cyclic, mine_paths_k3, result_roundtrip, top_patterns, pattern_set_ops, cost_quartiles)},
}

_BASE = """WITH v AS (
  SELECT 1000000000 + c_custkey AS id, CAST(100 + dense_rank() OVER (ORDER BY c_mktsegment) AS DOUBLE) AS label FROM customer
  UNION ALL SELECT 2000000000 + o_orderkey, CAST(200 + CAST(left(o_orderpriority, 1) AS INT) AS DOUBLE) FROM orders
  UNION ALL SELECT 3000000000 + p_partkey, CAST(300 + dense_rank() OVER (ORDER BY p_type) AS DOUBLE) FROM part
  UNION ALL SELECT 4000000000 + s_suppkey, CAST(400 AS DOUBLE) FROM supplier),
e AS (
  SELECT 1000000000 + o_custkey AS src, 2000000000 + o_orderkey AS dst, CAST(1 AS DOUBLE) AS l FROM orders
  UNION SELECT 2000000000 + l_orderkey, 3000000000 + l_partkey, CAST(2 AS DOUBLE) FROM lineitem
  UNION SELECT 2000000000 + l_orderkey, 4000000000 + l_suppkey, CAST(3 AS DOUBLE) FROM lineitem
  UNION SELECT 3000000000 + l_partkey, 4000000000 + l_suppkey, CAST(4 AS DOUBLE) FROM lineitem),
s AS (SELECT src, dst, l FROM e UNION ALL SELECT dst, src, l FROM e),
a AS (SELECT s.src, s.dst, s.l, x.label AS sl, y.label AS dl FROM s JOIN v AS x ON x.id = s.src JOIN v AS y ON y.id = s.dst),
share AS (SELECT count(*) AS c FROM customer),
pat AS (SELECT la, lb, el, min(n) AS mni FROM (SELECT sl AS la, dl AS lb, l AS el, unnest([count(DISTINCT src), count(DISTINCT dst)]) AS n
        FROM a WHERE sl <= dl GROUP BY sl, dl, l) GROUP BY la, lb, el),
deg AS (SELECT v.id, any_value(v.label) AS label, count(s.dst) AS degree FROM v LEFT JOIN s ON s.src = v.id GROUP BY v.id)"""


def _embedded(pattern: Pattern) -> str:
    """A CTE m of the embeddings, columns n0, n1, ..."""
    froms = ", ".join(f"v AS v{i}" for i in range(pattern.n_nodes)) + "".join(f", s AS s{k}" for k in range(pattern.n_edges))
    where = [f"v{i}.label = {x}" for i, x in enumerate(pattern.labels)]
    where += [f"s{k}.src = v{u}.id AND s{k}.dst = v{w}.id AND s{k}.l = {x}" for k, (u, w, x) in enumerate(pattern.edges)]
    where += [f"v{i}.id <> v{j}.id" for i in range(pattern.n_nodes) for j in range(i) if pattern.labels[i] == pattern.labels[j]]
    return _BASE + ",\nm AS (SELECT " + ", ".join(f"v{i}.id AS n{i}" for i in range(pattern.n_nodes)) + f" FROM {froms} WHERE " + " AND ".join(where) + ")"


def _mni_sql(pattern: Pattern) -> str:
    return _embedded(pattern) + "\nSELECT CAST(least(" + ", ".join(f"count(DISTINCT n{i})" for i in range(pattern.n_nodes)) + ") AS BIGINT) AS mni FROM m"


def _consistent_sql(pattern: Pattern, rounds: int = 5) -> str:
    """Rounds of semi-joins; enough for these patterns to stand still."""
    out = _BASE + "".join(f",\nd0_{i} AS (SELECT id FROM v WHERE label = {x})" for i, x in enumerate(pattern.labels))
    for r in range(1, rounds + 1):
        for i in range(pattern.n_nodes):
            tests = " AND ".join(f"id IN (SELECT s.src FROM s JOIN d{r - 1}_{j} AS d ON s.dst = d.id WHERE s.l = {x})" for j, x in pattern.around[i].items())
            out += f",\nd{r}_{i} AS MATERIALIZED (SELECT id FROM d{r - 1}_{i} WHERE {tests})"
    return out + "\n" + " UNION ALL ".join(f"SELECT {i} AS col, count(*) AS n, CAST(sum(id % 1000) AS BIGINT) AS sum_ids FROM d{rounds}_{i}" for i in range(pattern.n_nodes))


_MINED = """,
f AS (SELECT src AS c, dst AS o, sl AS cl, dl AS ol FROM a WHERE sl < 200),
k2 AS (SELECT x.cl, x.ol AS o1, y.ol AS o2, least(count(DISTINCT x.c), count(DISTINCT x.o), count(DISTINCT y.o)) AS mni
       FROM f AS x JOIN f AS y ON x.c = y.c AND x.o <> y.o AND x.ol <= y.ol GROUP BY x.cl, x.ol, y.ol),
k3 AS (SELECT x.cl, x.ol AS o1, y.ol AS o2, z.ol AS o3, least(count(DISTINCT x.c), count(DISTINCT x.o), count(DISTINCT y.o), count(DISTINCT z.o)) AS mni
       FROM f AS x JOIN f AS y ON x.c = y.c AND x.o <> y.o AND x.ol <= y.ol JOIN f AS z ON x.c = z.c AND x.o <> z.o AND y.o <> z.o AND y.ol <= z.ol GROUP BY x.cl, x.ol, y.ol, z.ol),
mined AS (SELECT 1 AS n_edges, la AS l1, lb AS l2, CAST(NULL AS DOUBLE) AS l3, mni FROM pat WHERE el = 1
  UNION ALL SELECT 2, cl, o1, o2, mni FROM k2),
found AS (SELECT * FROM mined WHERE mni >= (SELECT c * 11 // 100 FROM share))"""

_MINED3 = _BASE + _MINED + """ SELECT n_edges, l1, l2, l3, CAST(NULL AS DOUBLE) AS l4, mni FROM found
UNION ALL SELECT 3, cl, o1, o2, o3, mni FROM k3 WHERE mni >= (SELECT c * 11 // 100 FROM share)"""

#: low, high and verdict of rows with domain, n and valid, at 2.58 standard errors (Wilson).
_JUDGED = """
w AS (SELECT *, greatest(n, 1)::DOUBLE AS m, valid / greatest(n, 1)::DOUBLE AS p FROM counted),
i AS (SELECT *, (p + 2.58 * 2.58 / (2 * m)) / (1 + 2.58 * 2.58 / m) AS mid, 2.58 * sqrt(p * (1 - p) / m + 2.58 * 2.58 / (4 * m * m)) / (1 + 2.58 * 2.58 / m) AS wide FROM w),
j AS (SELECT *, domain * valid / m AS estimate, CASE WHEN n = domain THEN valid WHEN n = 0 THEN 0.0 ELSE domain * (mid - wide) END AS low,
  CASE WHEN n = domain THEN valid WHEN n = 0 THEN domain ELSE domain * (mid + wide) END AS high, (SELECT c * 11 // 100 FROM share) AS least FROM i),
said AS (SELECT *, CASE WHEN low >= least THEN 'frequent' WHEN high < least THEN 'infrequent' ELSE 'uncertain' END AS verdict FROM j)"""

_FOREST_SUMS = _BASE + """ SELECT count(*) AS n_vertices, CAST(sum(id) AS BIGINT) AS sum_ids, sum(label) AS sum_labels,
(SELECT count(*) FROM e WHERE l = 1) AS n_edges, (SELECT CAST(sum(src % 1000 + dst % 1000) AS BIGINT) FROM e WHERE l = 1) AS sum_ends FROM v WHERE label < 300"""

ORACLE = {
    "graph_vertices": _BASE + " SELECT id, label FROM v",
    "graph_edges": _BASE + " SELECT src, dst, l AS el FROM e",
    "label_histogram": _BASE + " SELECT label, count(*) AS n FROM v GROUP BY label",
    "frequent_labels": _BASE + """, o AS (SELECT id FROM v WHERE label IN (SELECT label FROM v GROUP BY label HAVING count(*) >= (SELECT c * 20 // 100 FROM share)))
SELECT (SELECT count(*) FROM o) AS n_vertices, (SELECT count(*) FROM e WHERE src IN (FROM o) AND dst IN (FROM o)) AS n_edges""",
    "degree_by_label": _BASE + " SELECT label, count(*) AS n, min(degree) AS min_degree, max(degree) AS max_degree, CAST(sum(degree) AS BIGINT) AS sum_degree FROM deg GROUP BY label",
    "lg_roundtrip_counts": _FOREST_SUMS,
    "lg_file_roundtrip": _FOREST_SUMS,
    "table_graph_counts": _FOREST_SUMS,
    "lg_text_graph": """WITH x AS (SELECT s_suppkey AS k, CAST(s_nationkey AS DOUBLE) AS l FROM supplier), p AS (SELECT x.k AS a, y.k AS b, x.l AS la, y.l AS lb FROM x JOIN x AS y ON y.k = x.k + 1)
SELECT a AS src, b AS dst, CAST(1 AS DOUBLE) AS label, la AS src_label, lb AS dst_label FROM p UNION ALL SELECT b, a, 1, lb, la FROM p""",
    "node_dump": _BASE + " SELECT src AS id, string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst) AS edges FROM e WHERE l = 1 GROUP BY src",
    "vertex_lookup": _BASE + " SELECT 3000000001 + p_partkey * 2 AS id, label, (SELECT count(*) FROM supplier) AS n_suppliers FROM part LEFT JOIN v ON v.id = 3000000001 + p_partkey * 2",
    "label_presence": _BASE + ", need(name, x, n) AS (VALUES " + ", ".join(f"('{k}', {x}, {p.labels.count(x)})" for k, p in CASES.items() for x in sorted(set(p.labels))) + """, ('stranger', 101.0, 1), ('stranger', 999.0, 1))
SELECT name, bool_and((SELECT count(*) FROM v WHERE v.label = need.x) >= need.n) AS present FROM need GROUP BY name""",
    "pattern_canonical_codes": _BASE + _MINED + """ SELECT CASE n_edges WHEN 1 THEN concat(l1, ' ', l2, '|0-1:1.0') ELSE concat(l1, ' ', l2, ' ', l3, '|0-1:1.0 0-2:1.0') END AS code,
n_edges + 1 AS n_nodes, n_edges, mni FROM found""",
    "occurrence_dump": _embedded(TRIANGLE) + " " + " UNION ".join(f"SELECT {i} AS col, n{i} AS id FROM m" for i in range(3)),
    "first_embeddings": _embedded(TRIANGLE) + " SELECT n0, n1, n2 FROM m QUALIFY row_number() OVER (PARTITION BY n2 ORDER BY n0, n1) = 1",
    "support_ci": _BASE + """,
k AS (SELECT src AS id FROM a WHERE sl = 101 AND dl = 201 AND l = 1 GROUP BY src HAVING count(*) >= 2),
o AS (SELECT dst AS id, dst IN (SELECT s.dst FROM s WHERE s.l = 1 AND s.src IN (FROM k)) AS ok FROM a WHERE sl = 101 AND dl = 201 AND l = 1),
counted AS (SELECT 0 AS col, count(*) AS domain, count(*) FILTER (id % 3 = 0) AS n, count(*) FILTER (id % 3 = 0) AS valid FROM k
  UNION ALL SELECT col, count(*), count(*) FILTER (id % 3 = 0), count(*) FILTER (id % 3 = 0 AND ok) FROM o, (VALUES (1), (2)) AS t(col) GROUP BY col),""" + _JUDGED + """
SELECT col, domain, n, valid, round(estimate, 6) AS estimate, round(low, 6) AS low, round(high, 6) AS high, verdict FROM said""",
    "mine_forest_k3": _MINED3,
    "mine_two_phase_k3": _MINED3,
    "mine_approx_k2": _BASE + _MINED + """,
pairs AS (SELECT p.la AS cl, p.lb AS o1, q.lb AS o2 FROM pat AS p JOIN pat AS q ON p.la = q.la AND p.lb <= q.lb
  WHERE p.la < 200 AND p.el = 1 AND q.el = 1 AND least(p.mni, q.mni) >= (SELECT c * 11 // 100 FROM share)),
per AS (SELECT cl, c, ol, count(*) AS k FROM f GROUP BY cl, c, ol),
centre AS (SELECT pairs.*, x.c FROM pairs JOIN per AS x ON x.cl = pairs.cl AND x.ol = o1 JOIN per AS y ON y.c = x.c AND y.ol = o2 WHERE o1 <> o2 OR x.k >= 2),
leaf AS (SELECT pairs.*, f.o, f.ol, f.c IN (SELECT t.c FROM centre AS t WHERE t.cl = pairs.cl AND t.o1 = pairs.o1 AND t.o2 = pairs.o2) AS ok FROM pairs JOIN f ON f.cl = pairs.cl AND f.ol IN (o1, o2)),
counted AS (SELECT pairs.cl, pairs.o1, pairs.o2, 0.0 AS ol, count(c) AS domain, count(c) FILTER (c % 3 = 0) AS n, count(c) FILTER (c % 3 = 0) AS valid FROM pairs LEFT JOIN centre USING (cl, o1, o2) GROUP BY ALL
  UNION ALL SELECT cl, o1, o2, ol, count(*), count(*) FILTER (o % 3 = 0), count(*) FILTER (o % 3 = 0 AND ok) FROM leaf GROUP BY ALL),""" + _JUDGED + """,
two AS (SELECT cl, o1, o2, CAST(floor(min(estimate)) AS BIGINT) AS mni, min(domain) AS room, bool_or(verdict = 'infrequent') AS bad, bool_and(n = domain) AS whole, bool_or(verdict = 'uncertain') AS open, any_value(least) AS least FROM said GROUP BY cl, o1, o2)
SELECT n_edges, l1, l2, l3, mni, 'exact' AS status FROM found WHERE n_edges = 1
UNION ALL SELECT 2, cl, o1, o2, mni, CASE WHEN whole THEN 'exact' WHEN open THEN 'uncertain' ELSE 'frequent' END FROM two WHERE NOT bad AND room >= least""",
    "mine_cyclic": _BASE + """,
g AS (SELECT * FROM a WHERE sl IN (201, 301, 400) AND dl IN (201, 301, 400)), least AS (SELECT c * 4 // 100 AS n FROM share),
one AS (SELECT sl AS x, dl AS y, l, least(count(DISTINCT src), count(DISTINCT dst)) AS mni FROM g WHERE sl < dl GROUP BY ALL),
two AS (SELECT x.sl AS c, x.dl AS p, y.dl AS q, least(count(DISTINCT x.src), count(DISTINCT x.dst), count(DISTINCT y.dst)) AS mni
  FROM g AS x JOIN g AS y ON x.src = y.src AND x.dst <> y.dst AND x.dl <= y.dl GROUP BY ALL),
three AS (SELECT least(count(DISTINCT x.src), count(DISTINCT x.dst), count(DISTINCT y.dst)) AS mni FROM g AS x JOIN g AS y ON x.src = y.src JOIN g AS z ON z.src = x.dst AND z.dst = y.dst
  WHERE x.sl = 201 AND x.dl = 301 AND y.dl = 400),
every AS (SELECT 1 AS n_edges, x AS l1, y AS l2, CAST(NULL AS DOUBLE) AS l3, mni FROM one
  UNION ALL SELECT 2, u[1], u[2], u[3], mni FROM (SELECT list_sort([c, p, q]) AS u, mni FROM two) UNION ALL SELECT 3, 201, 301, 400, mni FROM three)
SELECT n_edges, l1, l2, l3, count(*) AS n, CAST(sum(mni) AS BIGINT) AS sum_mni FROM every WHERE mni >= (SELECT n FROM least) GROUP BY ALL""",
    "result_roundtrip": _BASE + _MINED + " SELECT n_edges, count(*) AS n, CAST(sum(mni) AS BIGINT) AS sum_mni FROM found GROUP BY n_edges",
    "refuted_pattern": _embedded(TRIANGLE) + """,
d AS (SELECT col, count(*) AS n FROM (SELECT p.col, src FROM (VALUES (0, 201.0, 301.0, 2.0), (0, 201.0, 400.0, 3.0), (1, 301.0, 201.0, 2.0), (1, 301.0, 400.0, 4.0), (2, 400.0, 201.0, 3.0), (2, 400.0, 301.0, 4.0)) AS p(col, x, y, el)
  JOIN a ON sl = x AND dl = y AND l = el GROUP BY p.col, src HAVING count(DISTINCT dl) = 2) GROUP BY col),
f AS (SELECT col, n FROM d ORDER BY n // 2, col LIMIT 1),
i AS (SELECT 0 AS col, count(DISTINCT n0) AS k FROM m UNION ALL SELECT 1, count(DISTINCT n1) FROM m UNION ALL SELECT 2, count(DISTINCT n2) FROM m)
SELECT w.c AS support, CASE WHEN f.n < w.c OR i.k < w.c THEN f.col END AS col FROM (SELECT c FROM share UNION ALL SELECT 1) AS w, f JOIN i USING (col)""",
    "mni_square": _mni_sql(SQUARE),
    "support_ci_hash": _BASE + """,
h AS (SELECT id, ('0x' || left(md5('42:' || id), 8))::BIGINT AS h FROM v),
k AS (SELECT src AS id FROM a WHERE sl = 101 AND dl = 201 AND l = 1 GROUP BY src HAVING count(*) >= 2),
o AS (SELECT dst AS id, dst IN (SELECT s.dst FROM s WHERE s.l = 1 AND s.src IN (FROM k)) AS ok FROM a WHERE sl = 101 AND dl = 201 AND l = 1),
c AS (SELECT 0 AS col, id, true AS ok FROM k UNION ALL SELECT col, id, ok FROM o, (VALUES (1), (2)) AS t(col)),
t AS (SELECT col, ok, count(*) OVER (PARTITION BY col) AS domain, h.h FROM c JOIN h USING (id)),
counted AS (SELECT col, any_value(domain) AS domain, count(*) FILTER (domain <= 60 OR h < ceil(4294967296.0 * 60 / domain)) AS n, count(*) FILTER (ok AND (domain <= 60 OR h < ceil(4294967296.0 * 60 / domain))) AS valid FROM t GROUP BY col),""" + _JUDGED + """
SELECT col, domain, n, valid, round(estimate, 6) AS estimate, round(low, 6) AS low, round(high, 6) AS high, verdict FROM said""",
    "support_ci_bent": _embedded(BENT) + """,
h AS (SELECT id, ('0x' || left(md5('42:' || id), 8))::BIGINT AS h FROM v),
need(col, x, y, el, n, kinds) AS (VALUES (0, 201.0, 101.0, 1.0, 1, 1), (1, 101.0, 201.0, 1.0, 2, 1), (2, 201.0, 101.0, 1.0, 1, 2), (2, 201.0, 301.0, 2.0, 1, 2), (3, 301.0, 201.0, 2.0, 1, 1)),
own AS (SELECT sl, dl, l, src, count(*) AS n FROM a GROUP BY ALL),
c AS (SELECT col, src AS id FROM need JOIN own ON sl = x AND dl = y AND l = el AND own.n >= need.n GROUP BY col, src, kinds HAVING count(*) = kinds),
i AS (SELECT 0 AS col, n0 AS id FROM m UNION SELECT 1, n1 FROM m UNION SELECT 2, n2 FROM m UNION SELECT 3, n3 FROM m),
t AS (SELECT c.col, c.id, i.id IS NOT NULL AS ok, count(*) OVER (PARTITION BY c.col) AS domain, h.h FROM c JOIN h ON h.id = c.id LEFT JOIN i ON i.col = c.col AND i.id = c.id)
SELECT col, any_value(domain) AS domain, count(*) FILTER (domain <= 40 OR h < ceil(4294967296.0 * 40 / domain)) AS n, count(*) FILTER (ok AND (domain <= 40 OR h < ceil(4294967296.0 * 40 / domain))) AS valid FROM t GROUP BY col""",
    "mine_paths_k3": _BASE + """,
g AS (SELECT * FROM a WHERE sl IN (101, 201, 202, 301) AND dl IN (101, 201, 202, 301)), least AS (SELECT c * 9 // 100 AS n FROM share),
one AS (SELECT list_sort([sl, dl]) AS u, least(count(DISTINCT src), count(DISTINCT dst)) AS mni FROM g WHERE sl < dl GROUP BY sl, dl),
two AS (SELECT list_sort([x.sl, x.dl, y.dl]) AS u, least(count(DISTINCT x.src), count(DISTINCT x.dst), count(DISTINCT y.dst)) AS mni
  FROM g AS x JOIN g AS y ON x.src = y.src AND x.dst <> y.dst AND x.dl <= y.dl GROUP BY x.sl, x.dl, y.dl),
lines AS (SELECT list_sort([x.dl, x.sl, y.sl, y.dl]) AS u, least(count(DISTINCT x.dst), count(DISTINCT x.src), count(DISTINCT y.src), count(DISTINCT y.dst)) AS mni
  FROM g AS k JOIN g AS x ON x.src = k.src AND x.dst <> k.dst JOIN g AS y ON y.src = k.dst AND y.dst <> k.src AND y.dst <> x.dst
  WHERE (x.dl, x.sl, y.sl, y.dl) <= (y.dl, y.sl, x.sl, x.dl) GROUP BY x.dl, x.sl, y.sl, y.dl),
nb AS (SELECT src, sl, dst, dl FROM g),
stars AS (SELECT list_sort([x.sl, x.dl, y.dl, z.dl]) AS u, least(count(DISTINCT x.src), count(DISTINCT x.dst), count(DISTINCT y.dst), count(DISTINCT z.dst)) AS mni
  FROM nb AS x JOIN nb AS y ON x.src = y.src AND x.dst <> y.dst AND x.dl <= y.dl JOIN nb AS z ON z.src = x.src AND z.dst <> x.dst AND z.dst <> y.dst AND y.dl <= z.dl GROUP BY x.sl, x.dl, y.dl, z.dl),
every AS (SELECT 1 AS n_edges, * FROM one UNION ALL SELECT 2, * FROM two UNION ALL SELECT 3, * FROM lines UNION ALL SELECT 3, * FROM stars)
SELECT n_edges, u[1] AS l1, u[2] AS l2, u[3] AS l3, u[4] AS l4, count(*) AS n, CAST(sum(mni) AS BIGINT) AS sum_mni FROM every WHERE mni >= (SELECT n FROM least) GROUP BY ALL""",
    "edge_pattern_mni": _BASE + " SELECT la, lb, el, mni FROM pat",
    "frequent_edges": _BASE + " SELECT la, lb, el, mni FROM pat WHERE mni >= (SELECT c * 17 // 100 FROM share)",
    "two_edge_candidates": _BASE + """, f AS (SELECT * FROM pat WHERE mni >= (SELECT c * 17 // 100 FROM share)),
t AS (SELECT la AS c, el AS x, lb AS o FROM f UNION SELECT lb, el, la FROM f)
SELECT DISTINCT p.c AS centre, p.x AS e1, p.o AS l1, q.x AS e2, q.o AS l2 FROM t AS p JOIN t AS q ON p.c = q.c AND (p.x, p.o) <= (q.x, q.o)""",
    "domain_label_degree": _BASE + " SELECT col, count(*) AS n FROM deg JOIN (VALUES (0, 201.0), (1, 301.0), (2, 400.0)) AS p(col, x) ON label = x WHERE degree >= 2 GROUP BY col",
    "ac3_domains_path": _consistent_sql(PATH),
    "ac3_domains_triangle": _consistent_sql(TRIANGLE),
    "embeddings_path": _embedded(PATH) + " SELECT count(*) AS n, CAST(sum(n0 % 1000 + n3 % 1000) AS BIGINT) AS sum_ends FROM m",
    "embeddings_triangle": _embedded(TRIANGLE) + " SELECT count(*) AS n, CAST(sum(n1 % 1000) AS BIGINT) AS sum_parts FROM m",
    "mni_path": _mni_sql(PATH),
    "mni_unique_tree": _mni_sql(UNIQUE_TREE),
    "mni_triangle": _mni_sql(TRIANGLE),
    "mni_fork_same_label": _mni_sql(FORK),
    "mni_star3": _mni_sql(STAR3),
    "mni_table_bent": _embedded(BENT) + " " + " UNION ALL ".join(f"SELECT {i} AS col, count(DISTINCT n{i}) AS n FROM m" for i in range(4)),
    "mni_partitioned": _mni_sql(FORK),
    "one_column_refute": _embedded(TRIANGLE) + " SELECT count(DISTINCT n2) AS n, count(DISTINCT n2) < (SELECT c * 17 // 100 FROM share) AS refuted FROM m",
    "support_sample_frac": _embedded(FORK) + """,
k AS (SELECT src AS id FROM a WHERE sl = 101 AND dl = 201 AND l = 1 GROUP BY src HAVING count(*) >= 2),
o AS (SELECT dst AS id FROM a WHERE sl = 101 AND dl = 201 AND l = 1),
c AS (SELECT 0 AS col, id, id IN (SELECT n0 FROM m) AS ok FROM k UNION ALL SELECT 1, id, id IN (SELECT n1 FROM m) FROM o UNION ALL SELECT 2, id, id IN (SELECT n2 FROM m) FROM o)
SELECT col, count(*) AS sampled, count(*) FILTER (ok) AS valid, 3 * count(*) FILTER (ok) AS estimate FROM c WHERE id % 3 = 0 GROUP BY col""",
    "edge_label_lookup": _BASE + """ SELECT 2000000000 + o_orderkey AS src, 1000000001 + o_custkey % 7 AS dst, s.l AS el
FROM orders LEFT JOIN s ON s.src = 2000000000 + o_orderkey AND s.dst = 1000000001 + o_custkey % 7""",
    "edge_removal_isolated": _BASE + """, t AS (SELECT * FROM e WHERE l = 1), k AS (SELECT * FROM t WHERE src % 5 <> 0)
SELECT (SELECT count(*) FROM v WHERE label < 300) - (SELECT count(*) FROM (SELECT src FROM t WHERE src % 5 = 0 UNION SELECT dst FROM t WHERE src % 5 = 0)
  AS g(id) WHERE id NOT IN (SELECT src FROM k) AND id NOT IN (SELECT dst FROM k)) AS n_vertices, (SELECT count(*) FROM k) AS n_edges""",
    "vertex_removal": _BASE + " SELECT (SELECT count(*) FROM v WHERE label <> 400) AS n_vertices, (SELECT count(*) FROM e WHERE l < 3) AS n_edges",
    "neighbourhood_containment": _BASE + """ SELECT count(*) AS n, CAST(sum(id % 1000) AS BIGINT) AS sum_ids FROM (SELECT src AS id FROM a WHERE sl = 101 AND l = 1
GROUP BY src HAVING count(*) FILTER (dl = 201) >= 2 AND count(*) FILTER (dl = 202) >= 1)""",
    "connected_components": _BASE + " SELECT id, CASE WHEN label < 200 THEN id ELSE (SELECT min(src) FROM e WHERE l = 1 AND dst = id) END AS root FROM v WHERE label < 300",
    "mine_forest_k2": _BASE + _MINED + " SELECT n_edges, l1, l2, l3, mni FROM found",
    "top_patterns": _BASE + _MINED + " SELECT concat_ws('-', CAST(l1 AS INT), CAST(l2 AS INT), CAST(l3 AS INT)) AS code, mni FROM found ORDER BY mni DESC, code LIMIT 5",
    "pattern_set_ops": _BASE + _MINED + """, b AS (SELECT *, mni >= (SELECT c * 17 // 100 FROM share) AS big FROM found)
SELECT 'union' AS op, count(*) AS n, CAST(coalesce(sum(mni), 0) AS BIGINT) AS sum_mni FROM b WHERE n_edges = 1 OR big
UNION ALL SELECT 'minus', count(*), CAST(coalesce(sum(mni), 0) AS BIGINT) FROM b WHERE n_edges > 1
UNION ALL SELECT 'common', count(*), CAST(coalesce(sum(mni), 0) AS BIGINT) FROM b WHERE n_edges = 1 AND big""",
    "cost_quartiles": _BASE + """, q AS (SELECT label, list_sort(list(degree)) AS d, count(*) AS n FROM deg GROUP BY label)
SELECT label, d[CAST(floor(n * 0.25) AS INT) + 1] AS q1, d[CAST(floor(n * 0.5) AS INT) + 1] AS q2, d[CAST(floor(n * 0.75) AS INT) + 1] AS q3,
d[CAST(floor(n * 0.75) AS INT) + 1] + 1.5 * (d[CAST(floor(n * 0.75) AS INT) + 1] - d[CAST(floor(n * 0.25) AS INT) + 1]) AS fence FROM q""",
}
