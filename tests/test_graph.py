import random
from itertools import permutations

import pytest

from subgrove.functions.pattern import Pattern, edge, path, star
from subgrove.operators import domains as D
from subgrove.operators import edges as E
from subgrove.operators import mining as M
from subgrove.operators import sampling as SA
from subgrove.operators import support as SU
from subgrove.operators.embeddings import embeddings
from subgrove.sources import lg

A, B, C = 1.0, 2.0, 3.0
F1 = (dict(enumerate([B, A, A, A, B, A])), [(0, 1, 1), (0, 2, 1), (0, 3, 1), (4, 5, 1)])
F2 = (dict(enumerate([A] * 4)), [(0, 1, 1), (1, 2, 1), (0, 2, 1), (0, 3, 1)])
F3 = (dict(enumerate([A, B, C, A, B, C, A, B])), [(0, 1, 1), (1, 2, 1), (3, 4, 1), (4, 5, 1), (6, 7, 1)])
TRIANGLE = Pattern.of([A] * 3, [(0, 1, 1), (1, 2, 1), (0, 2, 1)])
PAW = Pattern.of([A] * 4, F2[1])
SQUARE = Pattern.of([A] * 4, [(0, 1, 1), (1, 2, 1), (2, 3, 1), (0, 3, 1)])


def load(spark, case):
    v, e = case
    return lg.from_text(spark, "# t 1\n" + "".join(f"v {i} {x}\n" for i, x in v.items()) + "".join(f"e {a} {b} {x}\n" for a, b, x in e))


def brute(case, p):
    labels, edges = case
    have = {(a, b): float(x) for s, t, x in edges for a, b in ((s, t), (t, s))}
    images = [set() for _ in p.labels]
    n = 0
    for m in permutations(labels, p.n_nodes):
        if all(labels[m[i]] == p.labels[i] for i in range(p.n_nodes)) and all(have.get((m[u], m[v])) == x for u, v, x in p.edges):
            n += 1
            for i, x in enumerate(m):
                images[i].add(x)
    return n, [len(s) for s in images]


@pytest.mark.parametrize(
    "case,pattern",
    [(F1, edge(A, B, 1)), (F1, path([A, B, A], [1, 1])), (F1, star(B, [A] * 3, [1] * 3)), (F2, TRIANGLE), (F2, path([A] * 4, [1] * 3)), (F2, PAW), (F2, SQUARE), (F3, path([A, B, C], [1, 1]))],
)
def test_support_against_brute_force(spark, case, pattern):
    g = load(spark, case)
    n, counts = brute(case, pattern)
    assert embeddings(g, pattern).count() == n
    assert SU.mni(g, pattern).first()[0] == min(counts)
    assert [r["n"] for r in SU.mni_table(g, pattern).orderBy("col").collect()] == counts


def test_edges_mining_and_sets(spark):
    g = load(spark, F2)
    assert [tuple(r) for r in E.edge_patterns(g).collect()] == [(A, A, 1.0, 4)]
    found = M.mine(g, M.Config(3))
    want = {edge(A, A, 1).code: 4, path([A] * 3, [1, 1]).code: 3, TRIANGLE.code: 3, path([A] * 4, [1] * 3).code: 3}
    assert {r["code"]: r["mni"] for r in found.collect()} == want
    assert M.mine(g, M.Config(5)).count() == 0
    assert M.top_patterns(found, 1).first()["mni"] == 4
    assert M.minus(found, M.top_patterns(found, 1)).count() == 3
    estimate, verdict = SA.sampled_support(g, TRIANGLE, 3)
    assert (estimate, verdict) == (3.0, "frequent")  # small domains are taken whole


def test_mining_against_brute_force(spark):
    r = random.Random(3)
    labels = {i: float(r.randint(1, 2)) for i in range(6)}
    case = (labels, [(i, j, 1) for i in labels for j in range(i) if r.random() < 0.5])
    found = {row["code"]: row["mni"] for row in M.mine(load(spark, case), M.Config(2, max_edges=2)).collect()}
    types = {(a, b, 1.0) for a in (1.0, 2.0) for b in (1.0, 2.0)}
    level = {edge(a, b, 1).code: edge(a, b, 1) for a, b, _ in types}
    level |= {q.code: q for p in list(level.values()) for q in p.extensions(types)}
    want = {c: n for c, p in level.items() if (n := min(brute(case, p)[1])) >= 2}
    assert found == want


def test_reader(spark, tmp_path):
    text = "# t 1\nv 0 1\nv 1 2\nv 1 9\nv 2 2\ne 0 1 1\ne 1 0 7\ne 2 2 1\ne 0 8 1\n"
    (tmp_path / "g.lg").write_text(text)
    g = lg.read_lg(spark, str(tmp_path / "g.lg"))
    assert sorted(map(tuple, g.vertices.collect())) == [(0, 1.0), (1, 2.0), (2, 2.0)]
    assert [tuple(r) for r in g.edges.collect()] == [(0, 1, 1.0)]
    assert {r["id"]: r["root"] for r in g.components().collect()} == {0: 0, 1: 0, 2: 2}
    lg.write_lg(g, str(tmp_path / "out"))
    again = lg.read_lg(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, again.edges.collect())) == [(0, 1, 1.0)]
    with pytest.raises(Exception, match="malformed"):
        lg.from_text(spark, "v x 1\n").vertices.collect()


def test_arc_consistency_holds_images(spark):
    g = load(spark, F3)
    found = D.as_table(D.ac3_domains(g, path([A, B, C], [1, 1]))).collect()
    assert sorted((r["col"], r["id"]) for r in found) == [(0, 0), (0, 3), (1, 1), (1, 4), (2, 2), (2, 5)]
    cyclic = D.as_table(D.ac3_domains(load(spark, F2), TRIANGLE)).collect()
    assert {(r["col"], r["id"]) for r in cyclic} >= {(c, i) for c in range(3) for i in range(3)}


def test_star_and_cycle_codes_are_quick():
    for n in (10, 14):
        star_of, cycle = star(A, [A] * n, [1] * n), Pattern.of([A] * n, [(i, (i + 1) % n, 1) for i in range(n)])
        moved = Pattern.of([A] * n, [((3 * i) % n, (3 * i + 3) % n, 1) for i in range(n)])  # 3 and n have no factor in common
        assert cycle.code == moved.code and cycle.code != path([A] * n, [1] * (n - 1)).code
        assert star_of.code == Pattern.of([A] * (n + 1), [(i, n, 1) for i in range(n)]).code


def test_images_of_repeated_labels_against_brute_force(spark):
    r = random.Random(9)
    case = ({i: float(r.randint(1, 2)) for i in range(7)}, [(i, j, r.randint(1, 2)) for i in range(7) for j in range(i) if r.random() < 0.55])
    g = load(spark, case).cached()
    for p in (path([A, B, A, A], [1, 1, 2]), star(A, [A, A, B], [1, 1, 2]), Pattern.of([A, A, B], [(0, 1, 1), (1, 2, 1), (0, 2, 2)]), Pattern.of([A, B, A, B], [(0, 1, 1), (1, 2, 1), (2, 3, 1), (0, 3, 1)])):
        _, counts = brute(case, p)
        assert [x["n"] for x in SU.mni_table(g, p).orderBy("col").collect()] == counts
        assert SU.mni_partitioned(g, p, 3).first()[0] == min(counts)
        least = SU.supports(g, {"p": p}, 3)["p"]
        assert least == min(counts) or max(least, min(counts)) < 3
        seeds = spark.createDataFrame([(i,) for i in range(7)], "id long")
        assert SU.first_embedding(g, p, 0, seeds).count() == counts[0]


def test_phases_agree(spark):
    r = random.Random(4)
    case = ({i: float(r.randint(1, 2)) for i in range(9)}, [(i, j, 1) for i in range(9) for j in range(i) if r.random() < 0.4])
    g = load(spark, case).cached()
    config = M.Config(3, max_edges=3, max_nodes=3)
    exact = {x["code"]: x["mni"] for x in M.mine(g, config).collect()}
    assert exact and {x["code"]: x["mni"] for x in M.mine_two_phase(g, config).collect()} == exact
    rows = M.mine_approx(g, config).collect()  # domains this small are drawn whole
    assert {x["code"]: x["mni"] for x in rows} == exact and {x["status"] for x in rows} == {"exact"}
    few = M.Config(3, max_edges=2, min_samples=2, sample_size=4)
    assert {x["code"]: x["mni"] for x in M.mine_two_phase(g, few).collect()} == {c: n for c, n in exact.items() if c.count(":") <= 2} | {x["code"]: x["mni"] for x in M.mine(g, M.Config(3, max_edges=2)).collect()}


def test_interval_of_nothing_is_not_nothing(spark):
    rows = spark.createDataFrame([(10_000, 300, 0), (10_000, 300, 300), (50, 50, 0), (40, 0, 0)], "domain long, n long, valid long")
    got = SA.judged(rows, 100, 2.58).collect()
    assert [r["verdict"] for r in got] == ["uncertain", "frequent", "infrequent", "infrequent"]
    assert got[0]["high"] > 100 and got[1]["low"] < 10_000


def test_command_line_and_result_text(spark, tmp_path):
    from subgrove.__main__ import main

    (tmp_path / "g.lg").write_text("# t 1\n" + "".join(f"v {i} {x}\n" for i, x in F2[0].items()) + "".join(f"e {a} {b} {x}\n" for a, b, x in F2[1]))
    main([str(tmp_path / "g.lg"), "--support", "3", "--out", str(tmp_path / "out")], spark)
    got = {r["code"]: r["mni"] for r in M.read_result(spark, str(tmp_path / "out")).collect()}
    assert got == {edge(A, A, 1).code: 4, path([A] * 3, [1, 1]).code: 3, TRIANGLE.code: 3, path([A] * 4, [1] * 3).code: 3}
    a, b = (M.mine(load(spark, F2).cached(), M.Config(n)) for n in (3, 4))
    assert M.union(a, b).count() == 4 and M.common(a, b).count() == 1 and M.minus(a, b).count() == 3


def test_arc_order_and_lookups(spark):
    assert TRIANGLE.held_by({A: 3}) and not TRIANGLE.held_by({A: 2, B: 9})
    assert SU.column_order(PAW, {0: 9, 1: 9, 2: 9, 3: 9}) == [0, 1, 2, 3] and SU.column_order(PAW, {i: 9 for i in range(4)}, 3)[0] == 3
    g = load(spark, F3).cached()
    assert g.by_label(A).count() == 3 and tuple(g.counts().first()) == (8, 5) and g.density() == 5 / 8
    assert g.alive()
