"""Importance resampling, whitening and the quality classifier against plain versions, and their odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from subgrove.llm import importance_resampling as I
from subgrove.llm import quality_kernel as Q
from subgrove.llm import whitening as Wh

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def features(text):
    words = _WORD.findall((text or "").encode().translate(_LOW))
    return words, [b" ".join(words[i : i + m]) for m in (1, 2, 3) for i in range(len(words) - m + 1)]


def plain_resampling(docs, target):
    """rows (doc_id, n_features, weight, score) and the ids drawn, in order."""
    found = [(k, *features(x)) for k, x in docs]
    bucket = lambda f: zlib.crc32(f) % 10000
    s, t = Counter(bucket(f) for _, _, fs in found for f in fs), Counter(bucket(f) for x in target for f in features(x)[1])
    every, aim = float(sum(s.values()) + 10000), float(sum(t.values()) + 10000)
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1.0) * every) / ((s[b] + 1.0) * aim)))
    rows = []
    for k, words, fs in found:
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        rows.append((k, len(words), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return rows, able


def _texts(n, seed=1):
    r = random.Random(seed)
    words = ["The", "cat", "Élan", "naïve", "x9", "42", "日本", "don't", "A-B", "z" * 60, "..", "ok", "a\tb", "\x00q\x7f", "È"]
    return [(k, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 2, 5, 30, 60])))) for k in range(n)]


def test_resampling_against_plain(spark):
    docs = [*_texts(120), (500, None), (501, ""), (502, "end"), (502, "end"), (None, "word " * 30), (None, None), (503, "long words " * 40_000), (504, "q" * 300_000 + " tail of it")]
    docs += [(600 + k, "the same copy of one text " * 8) for k in range(30)]
    target = [x for _, x in _texts(15, 2)] + [None, "the same copy of"]
    table = spark.createDataFrame([(k, x, "b", 1) for k, x in docs], "doc_id long, text string, rank string, weight int")
    aim = spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id long, text string")
    got = I.importance_resampling(table.repartition(5), aim, share=(40, 100), carry=("rank",)).toDF("doc_id", "carried", "n_words", "n_features", "weight", "score", "rank").collect()
    rows, able = plain_resampling(docs, target)
    assert Counter((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in got) == Counter(rows)
    drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, 40 * len(able) // 100 + 1))
    assert [(r["doc_id"], r["score"]) for r in drawn] == [(r[0], r[4]) for r in able[: len(drawn)]]
    assert {r["carried"] for r in got} == {"b"}


def test_resampling_of_little(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    aim = spark.createDataFrame([(1, "some text")], "item_id long, text string")
    assert I.importance_resampling(empty, aim).count() == 0
    docs = spark.createDataFrame([(k, "one two three " * 10) for k in range(40)], "doc_id string, text string")
    out = I.importance_resampling(docs, aim.where("false"))
    assert sorted(r["rank"] for r in out.where("rank IS NOT NULL").collect()) == [1, 2]
    assert out.select("weight").distinct().count() == 1


def test_ties_go_to_the_smaller_id(spark):
    rows = spark.createDataFrame([(k, "a " * 25) for k in (7, 7, 3, 9)], "doc_id long, text string")
    out = I.importance_resampling(rows, rows.selectExpr("doc_id AS item_id", "text"), share=(100, 100)).orderBy("rank").collect()
    assert [r["rank"] for r in out] == [1, 2, 3, 4]
    order = [(-r["score"], r["doc_id"]) for r in out]
    assert order == sorted(order) and [r["doc_id"] for r in out].count(7) == 2


def test_checksums_of_words():
    import pyarrow as pa

    texts = ["", "Ab cd", "", "éa--b9", "x", "yz " * 3 + "w" * 130, "  ", "q" * 49, "r" * 48]
    words = I.Words(pa.array(texts, pa.large_string()))
    want = [features(t) for t in texts]
    assert [sum(words.text == k) for k in range(len(texts))] == [len(w) for w, _ in want]
    got = sorted((int(words.text[j]), int(c)) for of, crc in words.grams(3) for j, c in zip(of, crc, strict=True))
    assert got == sorted((k, zlib.crc32(f)) for k, (_, fs) in enumerate(want) for f in fs)


def plain_whitening(vectors, k=4):
    x = np.floor(np.array(vectors, float) * 256).astype(np.int64)
    own = np.unique(x, axis=0)
    n, sums = len(own), own.sum(0)
    centred = own - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return x, n, sums, values[::-1], axes[:, ::-1]


@pytest.mark.parametrize("d,steep,passes", [(6, 1.0, 1), (40, 1.0, 4), (40, 0.5, 3)])
def test_whitening_against_plain(spark, d, steep, passes):
    r = np.random.default_rng(d)
    sizes = steep ** np.arange(d) if steep == 1 else np.where(np.arange(d) < 6, steep ** np.arange(d), 1e-4)
    base = r.normal(size=(300, d)) * sizes @ np.linalg.qr(r.normal(size=(d, d)))[0] * 40
    base = np.concatenate([base, base[:50], base[:1].repeat(200, 0)])
    odd = [(900, None, 1), (901, [float("nan")] * d, 1), (902, [None] + [1.0] * (d - 1), 1), (903, [float("inf")] * d, 1), (904, [], 1), (905, [1.0], 1)]
    rows = [(k, [float(v) for v in x], 7) for k, x in enumerate(base)] + [(None, [float(v) for v in base[0]], 7)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, n int").repartition(4)
    model = Wh.fit_whitening(table)
    x, n, sums, values, axes = plain_whitening([v for _, v, _ in rows])
    assert model.n == n and list(model.sums) == sums.tolist() and model.passes <= passes
    assert np.allclose(model.explained(), values[:4] / values.sum(), rtol=1e-9) and model.identity_error < 1e-8
    got = {row["vec_id"]: row for row in Wh.whitened(table, model).collect()}
    assert len(got) == len(rows)
    for k, (i, _, _) in enumerate(rows):
        assert int(got[i]["deviation"]) == int(((x[k] * n - sums) ** 2).sum())
    out = np.array([got[i]["whitened"] for i, _, _ in rows])
    want = (x - sums / n) @ axes[:, :4] / np.sqrt(values[:4])
    for c in range(4):
        assert min(np.abs(out[:, c] - want[:, c]).max(), np.abs(out[:, c] + want[:, c]).max()) < 1e-6


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert Wh.fit_whitening(spark.createDataFrame([], schema)) is None
    assert Wh.whitened(spark.createDataFrame([], schema), None).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)
    model = Wh.fit_whitening(one)
    assert model.n == 1 and model.identity_error == 0.0 and model.explained() == [None, None]
    assert [(int(r["deviation"]), r["whitened"]) for r in Wh.whitened(one, model).collect()] == [(0, [None, None])] * 2
    line = spark.createDataFrame([(k, [float(k), float(2 * k), 5.0]) for k in range(9)], schema)
    model = Wh.fit_whitening(line)
    assert model.usable.tolist() == [True, False, False] and model.identity_error < 1e-9
    big = spark.createDataFrame([(1, [1e14, -1e14]), (2, [-1e14, 0.0]), (3, [0.0, 3.0])], "vec_id long, embedding array<double>")
    model = Wh.fit_whitening(big)
    x = {1: (25600000000000000, -25600000000000000), 2: (-25600000000000000, 0), 3: (0, 768)}
    sums = [sum(v[i] for v in x.values()) for i in (0, 1)]
    assert list(model.sums) == sums
    assert {r["vec_id"]: r["deviation"] for r in Wh.whitened(big, model).collect()} == {k: Decimal(sum((3 * v[i] - sums[i]) ** 2 for i in (0, 1))) for k, v in x.items()}


def plain_isotonic(y, w):
    """By the minimax formula."""
    mean = lambda a, b: sum(v * u for v, u in zip(y[a:b], w[a:b], strict=True)) / sum(w[a:b])
    n = len(y)
    return [max(min(mean(a, b) for b in range(i + 1, n + 1)) for a in range(i + 1)) for i in range(n)]


def test_isotonic_against_minimax():
    r = random.Random(5)
    for n in (1, 2, 7, 15):
        y, w = [r.choice([0.0, 0.2, 1.0]) for _ in range(n)], [r.randint(1, 4) for _ in range(n)]
        at = np.arange(n, dtype=float)
        knots = Q.isotonic(at, np.array(w, float), np.array(y) * w)
        assert np.allclose(np.interp(at, *knots), plain_isotonic(y, w)) and (np.diff(knots[1]) >= 0).all()


def test_random_features_approach_the_kernel():
    r = np.random.default_rng(2)
    x = r.normal(size=(30, len(Q.STATISTICS)))
    kernel = Q.Kernel(np.zeros(x.shape[1]), np.ones(x.shape[1]), size=20_000)
    z = kernel(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * 6.0**2))
    assert np.abs(z @ z.T - want).max() < 0.05


def _quality(n):
    r = random.Random(4)
    good = lambda: " ".join(r.choice(["the", "river", "of", "stones", "and", "walked", "slowly"]) + r.choice(["", "", "", ".", ","]) for _ in range(r.randint(12, 80)))
    bad = lambda: " ".join(r.choice(["BUY!!", "###", "now***", "$$$", "x|y"]) for _ in range(r.randint(12, 80)))
    return [(k, good() if k % 3 else bad(), int(k % 3 > 0)) for k in range(n)]


def test_normal_equations_and_scores_against_plain(spark):
    rows = _quality(240)
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows], "doc_id long, text string, score string").repartition(5)
    labels = spark.createDataFrame([(k, q) for k, _, q in rows], "doc_id long, quality int")
    stats = Q.measured(docs)
    model = Q.train_quality(stats, labels, size=32)
    s = Q.statistics([t for _, t, _ in rows])
    assert np.allclose(model.kernel.mean, s.mean(0)) and np.allclose(model.kernel.spread, s.std(0))
    z, y = model.kernel(s), np.array([q for *_, q in rows], float)
    want = np.linalg.solve(z.T @ z + model.ridge * len(z) * np.diag(np.r_[np.ones(32), 1e-9]), z.T @ y)
    assert np.allclose(model.weights, want, rtol=1e-4, atol=1e-4)
    held = F.col("doc_id") % 4 == 0
    out = Q.quality_scores(docs, labels, ~held, carry=("score",))
    assert out.columns == ["doc_id", "score", "score", "predicted"]
    found = {r[0]: (r[2], r[3]) for r in out.collect()}
    assert sum(found[k][1] == q for k, _, q in rows if k % 4 == 0) >= 58 and all(0 <= p <= 1 for p, _ in found.values())


def test_quality_of_odd_rows(spark):
    rows = _quality(90)
    docs = [(k, t) for k, t, _ in rows] + [(None, "a text"), (None, None), (200, None), (201, ""), (202, "\n\n \t"), (203, "one"), (204, "word " * 300_000), (rows[1][0], rows[1][1]), (205, "é" * 100_000)]
    labels = [(k, q) for k, _, q in rows] + [(None, 1), (5, None), (9999, 0), (3, 0), (200, 0)]
    table = spark.createDataFrame([(k, t, "en") for k, t in docs], "doc_id long, text string, quality string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    out = Q.quality_scores(table, marks).collect()
    assert len(out) == len(docs) and all(r["score"] == r["score"] and 0 <= r["score"] <= 1 for r in out)
    blank = {r["score"] for r in out if r["doc_id"] in (200, 201, 202)}
    assert len(blank) == 1
    assert Q.quality_scores(table.where("false"), marks).count() == 0
    assert {r["score"] for r in Q.quality_scores(table, marks.where("false")).collect()} == {0.5}
    assert {r["score"] for r in Q.quality_scores(table, marks.where("quality = 1 AND doc_id IS NOT NULL")).collect()} == {1.0}


def test_statistics_of_a_text():
    s = dict(zip(Q.STATISTICS, Q.statistics(["The cat the cat\n\nThe cat the cat\nA1 ###"])[0], strict=True))
    assert s["log_words"] == np.log1p(10) and s["repeated_lines"] == pytest.approx(1 / 3) and s["symbols"] == pytest.approx(0.3)
    assert s["distinct"] == pytest.approx(0.5) and s["most_common"] == pytest.approx(0.4) and s["capital_words"] == pytest.approx(0.3) and s["letterless_words"] == pytest.approx(0.1)
    assert s["same_as_before"] == 0 and s["digits"] == pytest.approx(1 / len("The cat the cat\n\nThe cat the cat\nA1 ###"))
    assert not Q.statistics([None, "", " \n"]).any()
