"""The search from seeds, the graph's tables and sampling, against brute force and by the plans that they make."""

import os
import random
from itertools import permutations

import pytest

from subgrove.functions.pattern import Pattern, path, star
from subgrove.operators import domains as D
from subgrove.operators import mining as M
from subgrove.operators import sampling as SA
from subgrove.operators import support as SU
from subgrove.operators.embeddings import FanOuts, embeddings, fan_outs, join_order
from subgrove.operators.search import Images, Task, signatures, valid, witnesses
from subgrove.plans import catalog
from subgrove.plans.graph import CachedGraph, Graph
from subgrove.plans.shared import kept, remove, shared_folder

A, B, C = 1.0, 2.0, 3.0
SQUARE = Pattern.of([A, A, B, B], [(0, 1, 1), (1, 2, 1), (2, 3, 1), (0, 3, 1)])
TRIANGLE = Pattern.of([A, A, B], [(0, 1, 1), (1, 2, 1), (0, 2, 1)])
BENT = path([A, B, A, A], [1, 1, 1])


def graph(spark, labels, edges, **more):
    v = spark.createDataFrame(sorted(labels.items()), "id long, label double")
    e = spark.createDataFrame([(min(a, b), max(a, b), float(x)) for a, b, x in edges], "src long, dst long, label double")
    return CachedGraph(Graph.clean(v, e), **more)


def dense(seed, n, share):
    r = random.Random(seed)
    return {i: float(r.randint(1, 2)) for i in range(n)}, [(i, j, 1) for i in range(n) for j in range(i) if r.random() < share]


def all_of(case, p):
    labels, edges = case
    have = {(a, b): float(x) for s, t, x in edges for a, b in ((s, t), (t, s))}
    return [m for m in permutations(labels, p.n_nodes) if all(labels[m[i]] == p.labels[i] for i in range(p.n_nodes)) and all(have.get((m[u], m[v])) == x for u, v, x in p.edges)]


def files(spark):
    folder = shared_folder(spark).removeprefix("file://")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_search_of_cut_lists_against_brute_force(spark):
    case = dense(5, 9, 0.6)
    for hub, head in ((2, 1), (1000, 64)):
        g = graph(spark, *case, hub=hub, head=head)
        assert g.hubs == (hub == 2)
        assert sorted(map(tuple, g.edges.select("src", "dst").collect())) == sorted((min(a, b), max(a, b)) for a, b, _ in case[1])
        tasks, patterns = {}, (SQUARE, TRIANGLE, BENT)
        sigs = signatures(patterns)
        domains = D.many_domains(g, list(sigs))
        for p in patterns:
            for i in range(p.n_nodes):
                tasks[len(tasks)] = Task.of(g, p, i)
        seeds = spark.createDataFrame([(t, i) for t, task in tasks.items() for i, x in case[0].items() if x == task.pattern.labels[task.order[0]]], "task int, id long")
        want = {t: {m[task.order[0]] for m in all_of(case, task.pattern)} for t, task in tasks.items()}
        got = {t: set() for t in tasks}
        for r in valid(g, tasks, seeds, domains, sigs).collect():
            got[r["task"]].add(r["id"])
        assert got == want
        for r in witnesses(g, tasks, seeds, ways=2).collect():
            task = tasks[r["task"]]
            m = tuple(r["m"][task.order.index(i)] for i in range(task.pattern.n_nodes))
            assert r["m"][0] == r["seed"] and m in all_of(case, task.pattern)
        for p in patterns:
            assert {tuple(r) for r in embeddings(g, p).collect()} == set(all_of(case, p))
            least = {r[p.n_nodes - 1]: tuple(r) for r in SU.first_embedding(g, p, p.n_nodes - 1, g.vertices, ways=1).collect()}
            order = join_order(p, p.n_nodes - 1)
            assert least == {s: min((m for m in all_of(case, p) if m[-1] == s), key=lambda m: [m[i] for i in order]) for s in {m[-1] for m in all_of(case, p)}}
        g.drop()


def test_graph_of_some_kinds_against_the_whole(spark):
    r = random.Random(11)
    v = [(i, float(r.randint(1, 4))) for i in range(20)] + [(0, 1.0), (1, 9.0), (2, 1.0)]  # some twice, the least label wins
    e = [(r.randrange(20), r.randrange(20), float(r.randint(1, 2))) for _ in range(260)] + [(3, 99, 1.0), (4, 4, 1.0)]  # pairs both ways round, with two labels, no vertex, loops
    v, e = spark.createDataFrame(v, "id long, label double"), spark.createDataFrame(e, "src long, dst long, label double")
    whole = Graph.clean(v, e).cached()
    whole.lists
    for p in (SQUARE, Pattern.of([A, B, C], [(0, 1, 1), (1, 2, 2), (0, 2, 1)])):
        part = Graph.clean(v, e, kinds=p.kinds)
        assert sorted(map(tuple, part.vertices.collect())) == sorted(tuple(x) for x in whole.vertices.collect() if x["label"] in p.labels)
        columns = ["src", "dst", "label", "src_label", "dst_label"]
        want = sorted(tuple(x) for x in whole.adj.select(columns).collect() if (x["src_label"], x["label"], x["dst_label"]) in p.kinds)
        small = part.cached()
        assert want and sorted(map(tuple, part.adj.select(columns).collect())) == want == sorted(map(tuple, small.adj.select(columns).collect()))
        assert sorted(map(tuple, part.edges.collect())) == sorted((a, b, x) for a, b, x, _, _ in want if a < b)
        assert sorted(map(tuple, SU.images(small, p).collect())) == sorted(map(tuple, SU.images(whole, p).collect()))
        small.drop()
    whole.drop()


def test_written_tables_leave_no_shuffle_files(spark):
    files_of = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    name, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", files_of()
    old = spark.conf.get(name)
    rows, path_ = kept(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count())
    assert not files_of() - before and spark.conf.get(name) == old and rows.count() == 7
    remove(spark, path_)


def test_occurrences_write_their_own_kinds_only(spark):
    catalog.drop_graphs()
    folder = "/root/testdata/sf0.001"
    got = sorted(map(tuple, catalog.occurrence_dump(spark, folder).collect()))
    part = catalog._graph(spark, folder, pattern=catalog.TRIANGLE)
    assert {(r["src_label"], r["label"], r["dst_label"]) for r in part.lists.collect()} == set(catalog.TRIANGLE.kinds)
    whole = catalog._graph(spark, folder)
    assert "lists" not in whole.__dict__
    assert got == sorted(map(tuple, SU.images(whole, catalog.TRIANGLE).collect()))
    assert "lists" in whole.__dict__ and catalog._graph(spark, folder, pattern=catalog.TRIANGLE) is whole  # what is there is used
    catalog.drop_graphs()


def test_supports_write_their_own_kinds_only(spark):
    catalog.drop_graphs()
    folder = "/root/testdata/sf0.001"
    got = catalog.QUERIES["mni_square"](spark, folder).first()[0]
    whole = catalog._graph(spark, folder)
    assert "lists" not in whole.__dict__
    part = catalog._graph(spark, folder, pattern=catalog.SQUARE)
    assert {(r["src_label"], r["label"], r["dst_label"]) for r in part.lists.collect()} <= set(catalog.SQUARE.kinds)
    every = embeddings(whole, catalog.SQUARE).collect()
    assert got == min(len({r[i] for r in every}) for i in range(4)) > 0
    catalog.drop_graphs()


def test_witnesses_spare_searches(spark):
    labels = {**{i: A for i in range(60)}, **{100 + i: B for i in range(60)}}
    g = graph(spark, labels, [(i, 100 + i, 1) for i in range(60)] + [(i, (i + 1) % 60, 1) for i in range(60)])
    p = path([B, A, A, B], [1, 1, 1])
    assert p.orbits == (0, 1, 1, 0)
    found = Images(g, {"": p})
    assert found.complete({"": [1, 0, 2, 3]}, 1, wave=0) == {"": 60}
    assert 0 < sum(found.searched.values()) < 120  # four nodes of 60 candidates each
    cycle = Pattern.of([A] * 5, [(i, (i + 1) % 5, 1) for i in range(5)])
    assert set(cycle.orbits) == {0}
    first = Images(g, {"c": cycle, "p": p})
    assert first.complete({"c": list(range(5)), "p": [3, 2, 1, 0]}, 61) == {"c": 60, "p": 60} and not first.searched  # domains are too small for the support
    assert first.complete({"c": list(range(5))}, 1) == {"c": 0}
    few = Images(g, {"": p})
    assert few.complete({"": [0, 1]}, 60, wave=10) == {"": 60}  # in waves
    for x in (found, first, few):
        x.drop()


def test_a_hub_stays_linear(spark):
    n = 3000
    labels = {0: C, **{i: A for i in range(1, n + 1)}, **{n + i: B for i in range(1, n + 1)}}
    edges = [(0, i, 1) for i in range(1, n + 1)] + [(0, n + i, 1) for i in range(1, n + 1)] + [(n, n + n, 1)]
    g = graph(spark, labels, edges, hub=100, head=16)
    wedge, triangle = path([A, C, A], [1, 1]), Pattern.of([A, B, C], [(0, 1, 1), (1, 2, 1), (0, 2, 1)])
    task = {0: Task.of(g, wedge, 0)}
    seeds = g.by_label(A).selectExpr("0 AS task", "id")
    rows = witnesses(g, task, seeds)
    assert rows.count() == n  # nine million embeddings
    assert SU.mni(g, wedge).first()[0] == 1
    found = SU.first_embedding(g, triangle, 2, g.by_label(C), ways=2).collect()
    assert [tuple(r) for r in found] == [(n, n + n, 0)]
    assert SU.mni(g, triangle).first()[0] == 1


def test_lists_are_not_dealt_again(spark):
    g = graph(spark, *dense(6, 12, 0.5))
    g.fan_out
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tasks = {0: Task.of(g, TRIANGLE, 0)}
        rows = witnesses(g, tasks, g.by_label(A).selectExpr("0 AS task", "id"))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        lines = [(len(x) - len(x.lstrip(" :+-")), x) for x in plan.split("\n")]
        scans = [k for k, (_, x) in enumerate(lines) if "Scan parquet" in x and "dsts" in x]
        assert len(scans) >= 3
        for k in scans:
            assert "Bucketed: true" in lines[k][1]
            depth, above = lines[k][0], []
            for d, x in lines[:k][::-1]:  # what stands above it, nearest first
                if d < depth:
                    depth = d
                    above.append(x)
            assert not any("Exchange" in x for x in above[: next(i for i, x in enumerate(above) if "Join" in x)])
        domains = D.many_domains(g, [D.signature(TRIANGLE, 0)])._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in domains
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_orders_follow_fan_outs():
    p = path([A, B, C, A], [1, 2, 3])
    rare_end = FanOuts({A: 1000, B: 1000, C: 10}, {(A, 1.0, B): 50_000, (B, 1.0, A): 50_000, (B, 2.0, C): 20, (C, 2.0, B): 20, (C, 3.0, A): 5, (A, 3.0, C): 5})
    assert join_order(p, None, rare_end)[0] in (2, 3) and join_order(p, None, rare_end)[-1] == 0
    other = FanOuts({A: 1000, B: 3, C: 1000}, {(A, 1.0, B): 4, (B, 1.0, A): 4, (B, 2.0, C): 900, (C, 2.0, B): 900, (C, 3.0, A): 50_000, (A, 3.0, C): 50_000})
    assert join_order(p, None, other)[:2] in ([0, 1], [1, 0]) and join_order(p, 2, other)[0] == 2


def test_star_bitmaps_of_many_stars(spark):
    r = random.Random(8)
    labels = {i: float(r.randint(1, 8)) for i in range(40)}
    g = graph(spark, labels, [(i, j, r.randint(1, 2)) for i in range(40) for j in range(i) if r.random() < 0.4])
    stars = {}
    for a in range(1, 9):
        for b in range(1, 9):
            for c in range(b, 9):
                if a not in (b, c):
                    p = star(float(a), [float(b), float(c)], [1, r.randint(1, 2)])
                    stars[p.code] = p
    assert len({D.signature(p, SU.star_centre(p)) for p in stars.values()}) > 120  # three words
    got = SU.star_supports(g, stars)
    have = {}
    for e in g.adj.collect():
        have.setdefault(e["src"], []).append((e["dst"], e["label"], e["dst_label"]))
    for code, p in stars.items():
        c = SU.star_centre(p)
        (i, x), (j, y) = p.around[c].items()
        rows = [(u, v, w) for u, around in have.items() if labels[u] == p.labels[c] for v, e, l in around if (e, l) == (x, p.labels[i]) for w, f, m in around if (f, m) == (y, p.labels[j]) and w != v]
        assert got[code] == (min(len({r[k] for r in rows}) for k in range(3)) if rows else 0), code


def test_draws_are_nested_and_leave_no_tables(spark):
    case = dense(4, 30, 0.3)
    g = graph(spark, *case)
    g.fan_out
    p = path([A, B, A, B], [1, 1, 1])
    every = SA.drawn(g, {"": p}, SA.Draw(size=1000)).collect()
    counts = SU.mni_table(g, p).orderBy("col").collect()
    assert [(r["col"], r["valid"]) for r in sorted(every, key=lambda r: r["col"])] == [(r["col"], r["n"]) for r in counts] and all(r["domain"] == r["n"] for r in every)
    small, large = SA.Draw(size=4), SA.Draw(size=9)
    one, both = (SA.counted(g, {"": p}, d)[""] for d in (small, large))
    rest = SA.counted(g, {"": p}, SA.Draw(size=9, after=4))[""]
    assert [(d, n + m, v + w) for (d, n, v), (_, m, w) in zip(one, rest, strict=True)] == both
    before = files(spark)
    config = M.Config(4, max_edges=2, min_samples=3, sample_size=8)
    assert M.predict(g, config, exact_stars=True) and M.mine_two_phase(g, config).count() == M.mine(g, config).count()
    assert files(spark) == before


def test_judgements_agree(spark):
    rows = [(10_000, 300, 0), (10_000, 300, 300), (50, 50, 0), (40, 0, 0), (70, 9, 4), (500, 60, 31)]
    got = SA.judged(spark.createDataFrame(rows, "domain long, n long, valid long"), 100, 2.58).collect()
    assert [(r["estimate"], r["verdict"]) for r in got] == [SA.judge(*x, 100, 2.58) for x in rows]


@pytest.mark.parametrize("suspect", [None, 2])
def test_counters_of_arcs_against_brute_force(spark, suspect):
    case = dense(9, 14, 0.3)
    g = graph(spark, *case)
    for p in (TRIANGLE, SQUARE):
        have = {(a, b) for s, t, _ in case[1] for a, b in ((s, t), (t, s))}
        want = {i: {v for v, x in case[0].items() if x == p.labels[i]} for i in range(p.n_nodes)}
        while True:
            less = {i: {v for v in want[i] if all(any((v, w) in have for w in want[j]) for j in p.around[i])} for i in want}
            if less == want:
                break
            want = less
        found = {i: {r["id"] for r in d.collect()} for i, d in D.ac3_domains(g, p, suspect=suspect).items()}
        images = {r["col"]: set() for r in SU.images(g, p).collect()}
        assert all(found[i] <= want[i] for i in want) and all(i in found for i in images)
        once = {i: {r["id"] for r in d.collect()} for i, d in D.domains(g, p).items()}
        while True:  # from the domains by kinds of edges
            less = {i: {v for v in once[i] if all(any((v, w) in have for w in once[j]) for j in p.around[i])} for i in once}
            if less == once:
                break
            once = less
        assert found == once
