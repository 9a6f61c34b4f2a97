import random
from itertools import permutations

import pytest

from subgrove.functions.pattern import Pattern, edge, path, star, two_edge


def graph(labels, edges):
    number = {k: i for i, k in enumerate(labels)}
    return Pattern.of(list(labels.values()), [(number[a], number[b], x) for a, b, x in edges])


def test_codes_of_known_pairs():
    a = graph({0: 1, 1: 1, 2: 2, 3: 2, 4: 2}, [(1, 2, 2), (0, 3, 2), (3, 4, 1), (4, 0, 2)])
    b = graph({0: 1, 2: 2, 3: 2, 4: 2}, [(0, 3, 2), (3, 4, 1), (4, 0, 2)])
    assert a.code != b.code
    a = graph({0: 2, 1: 1, 2: 1, 3: 2}, [(0, 2, 2), (0, 3, 2), (1, 3, 1), (1, 2, 1)])
    b = graph({3: 2, 1: 1, 2: 1, 0: 2}, [(3, 2, 2), (3, 0, 2), (1, 0, 1), (1, 2, 1)])
    assert a.code == b.code
    one = {i: 1 for i in range(8)}
    a = graph(one, [(0, 1, 1), (0, 7, 1), (0, 6, 1), (1, 5, 1), (1, 2, 1), (2, 4, 1), (2, 3, 1)])
    b = graph(one, [(1, 0, 1), (1, 2, 1), (1, 6, 1), (0, 5, 1), (0, 7, 1), (7, 3, 1), (7, 4, 1)])
    assert a.code == b.code


def isomorphic(p, q):
    if len(p.labels) != len(q.labels):
        return False
    want = set(q.edges)
    for m in permutations(range(p.n_nodes)):
        if all(p.labels[i] == q.labels[m[i]] for i in range(p.n_nodes)) and {(min(m[u], m[v]), max(m[u], m[v]), x) for u, v, x in p.edges} == want:
            return True
    return False


def test_code_is_isomorphism():
    r = random.Random(5)
    found = []
    for _ in range(60):
        n = r.randint(2, 5)
        p = Pattern.of([r.randint(1, 2) for _ in range(n)], [(i, j, r.randint(1, 2)) for i in range(n) for j in range(i) if r.random() < 0.6])
        m = list(range(n))
        r.shuffle(m)
        back = [0] * n
        for i, k in enumerate(m):
            back[k] = p.labels[i]
        assert Pattern.of(back, [(m[u], m[v], x) for u, v, x in p.edges]).code == p.code
        found.append(p)
    for p in found[:30]:
        for q in found[:30]:
            assert (p.code == q.code) == isomorphic(p, q)


def test_parts_extensions_and_text():
    paw = Pattern.of([1, 1, 1, 1], [(0, 1, 1), (1, 2, 1), (0, 2, 1), (0, 3, 1)])
    assert set(paw.parts()) == {Pattern.of([1] * 3, [(0, 1, 1), (1, 2, 1), (0, 2, 1)]).code, path([1] * 4, [1] * 3).code, star(1, [1] * 3, [1] * 3).code}
    assert paw.connected() and not paw.acyclic() and not paw.unique_labels()
    assert Pattern.from_lg(paw.to_lg()).code == paw.code
    assert len(two_edge([(1, 2, 1)])) == 2
    assert edge(1, 2, 1).code == edge(2, 1, 1).code
    assert edge(1, 1, 1).held_by({1: 2}) and not edge(1, 2, 1).held_by({1: 5})
    with pytest.raises(ValueError):
        Pattern.of([1], [(0, 0, 1)])
