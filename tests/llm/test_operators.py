"""Operators against plain versions, on small rows that hold nulls, empty texts, ties and clashing columns."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from subgrove.llm import simple8b as S
from subgrove.llm.chat_rotation import perspective_rotation
from subgrove.llm.components import components
from subgrove.llm.decontamination import MATCH, align, decontaminate
from subgrove.llm.line_templates import line_templates
from subgrove.llm.ngram_jaccard import ngram_jaccard
from subgrove.llm.quality_rules import POLICIES, RULES, ablation, judged, ledger
from subgrove.llm.stupid_backoff import _grams, stupid_backoff
from subgrove.llm.substring_dedup import substring_dedup
from subgrove.llm.toxic_spans import fit, toxic_spans
from subgrove.llm.vector_packing import Bin, best_fit_packing, plan

R = random.Random(11)
WORDS = [a + b + c for a in "bcdfghklmn" for b in "aeiou" for c in "prstvxyz"]


def text(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def edited(t, k):
    w = t.split()
    for _ in range(k):
        w[R.randrange(len(w))] = R.choice(WORDS)
    return " ".join(w)


PASSAGE, BASE = text(60), text(120)
TEXTS = [None, "", " \n", "one", "one two", text(30), PASSAGE, text(20) + " " + PASSAGE + "\n" + text(15), PASSAGE + " " + PASSAGE, BASE, BASE, BASE.upper(), *(edited(BASE, k) for k in (1, 2, 3, 4, 6, 8)), text(5), "x " * 3000, *(text(200) for _ in range(5))]
ROWS = [(i, t, i, "clash") for i, t in enumerate(TEXTS)] + [(None, BASE, 0, "null id")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, chunk long, bucket string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_substring_dedup(docs, none):
    seen = Counter()
    split = [(i, (t or "").split()) for i, t, *_ in ROWS]
    for _, w in split:
        seen.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    want = []
    for i, w in split:
        gone = {k + j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(35)}
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert substring_dedup(none).count() == 0


def test_ngram_jaccard(docs, none):
    def shingles(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [(i, shingles(t)) for i, t, *_ in ROWS]
    root = list(range(len(sets)))
    for _ in sets:
        for a, (_, x) in enumerate(sets):
            for b, (_, y) in enumerate(sets):
                if x and 100 * len(x & y) >= 75 * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
    want = [(i, len(s), min(j for k, (j, _) in enumerate(sets) if root[k] == root[n] and j is not None)) for n, (i, s) in enumerate(sets)]
    got = [tuple(r) for r in ngram_jaccard(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert ngram_jaccard(none).count() == 0


def test_jaccard_families(spark):
    rows, made = [], 0
    for _ in range(4):
        base = text(R.randint(8, 90))
        for k in range(12):
            rows.append((made, edited(base, k % 6)))
            made += 1
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for _, t in rows for w in [t.split()]]
    root = list(range(made))
    for _ in range(made):
        for a in range(made):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(made)] == root


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (1, 2), (7, 7)], "a long, b long")
    assert {r["node"]: r["root"] for r in components(edges).collect()} == {4: 3, 5: 3, 9: 3, 2: 1}


def test_rule_ledger(docs, none):
    rows = ledger(docs)
    by = {r["doc_id"]: r for r in rows.collect() if r["doc_id"] is not None}
    for i, t, *_ in ROWS[:-1]:
        w = (t or "").split()
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        assert (by[i]["n_words"], by[i]["word_chars"], by[i]["n_repeat_words"]) == (len(w), sum(map(len, w)), len(again))
    kept = judged(rows, POLICIES["v2"])
    one = {r["rule"]: r for r in ablation(rows, POLICIES["v2"]).collect()}
    assert set(one) == set(RULES)
    failed = [r["failed"] for r in kept.collect()]
    for k, rule in enumerate(RULES):
        assert one[rule]["n_failed"] == sum(x >> k & 1 for x in failed)
        assert one[rule]["n_kept_without"] == sum(x & ~(1 << k) == 0 for x in failed)
    assert ledger(none).count() == 0


def test_stupid_backoff(docs, none):
    split = [(t or "").split() for _, t, *_ in ROWS]
    c = Counter(tuple(w[k : k + n]) for w in split for n in (1, 2, 3) for k in range(len(w) - n + 1))
    total = sum(map(len, split))
    want = []
    for w in split:
        s = 0.0
        for k in range(len(w)):
            top = min(k + 1, 3)
            n = next((n for n in range(top, 1, -1) if c[tuple(w[k - n + 1 : k + 1])] >= 2), 1)
            own = c[tuple(w[k - n + 1 : k + 1])]
            s += np.log(0.4) * (top - n) + np.log(own / (c[tuple(w[k - n + 1 : k])] if n > 1 else total))
        want.append(s)
    got = sorted(r["log_score"] for r in stupid_backoff(docs).collect())
    assert np.allclose(got, sorted(want))
    assert stupid_backoff(none).count() == 0


def test_stupid_backoff_keys_are_whole():
    keys = np.unique(_grams([text(300)])[0])
    assert len(np.unique(keys & np.uint64(0xFFFF))) > len(keys) // 2  # the low bits count, too


def test_simple8b_bytes():
    r = np.random.default_rng(2)
    for v in ([], [0] * 5000, r.integers(0, 50000, 9001), [2**64 - 1, 0, 2**60, 2**60 - 1] * 1500):
        v = np.array(v, np.uint64)
        assert (S.decode(S.encode(v)) == v).all()
    assert (S.decode(S.encode(v), range(1, 2)) == v[4096:8192]).all()


def test_token_files_and_packing(docs, none):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    start = 0
    got = sorted(S.read_token_files(docs.sparkSession, S.write_token_files(docs, path, 2)).collect(), key=lambda r: r["start"])
    for r, (i, x, *_) in zip(got, sorted(ROWS, key=lambda r: (r[0] is not None, r[0])), strict=True):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], list(r["ids"])) == (i, start, len(ids), ids)
        start += len(ids)
    assert S.read_token_files(none.sparkSession, S.write_token_files(none, path, 2)).count() == 0
    rows = best_fit_packing(docs, path, 2, Bin(tokens=256, docs=8, attention=256 * 256)).toPandas()
    assert rows["length"].sum() == start
    for _, x in rows.sort_values("offset").groupby("sequence_id"):
        assert list(x["offset"]) == [0, *x["length"].cumsum()[:-1]] and x["length"].sum() <= 256 and len(x) <= 8
    assert best_fit_packing(none, path).count() == 0


def test_plan_places_everything_once():
    sizes = Counter(R.randint(1, 100) for _ in range(500))
    for bin in (Bin(100, 7, 100 * 100), Bin(100, 7, 100 * 100, rule="dot")):
        load = Counter()
        placed = Counter()
        for length, rank, n, each, first, offset in plan(dict(sizes), bin).tolist():
            placed[length] += n
            for j in range(n):
                load[first + j // each] += length
        assert placed == sizes and max(load.values()) <= 100
    assert len(plan({100: 10**9})) == 1  # its work follows the lengths


def test_perspective_rotation(spark):
    turns = spark.createDataFrame([(1, 1, "b", "hi"), (1, 0, "system", "S"), (1, 0, "a", None), (2, 0, "system", "x"), (None, None, None, "t"), (1, 1, "b", "hi")], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["perspective"]): r for r in perspective_rotation(turns).collect()}
    assert set(got) == {(1, "a"), (1, "b"), (None, "unknown")}
    r = got[1, "b"]
    assert r["rendered"] == "<|turn|>user name=a\n<|end|>\n<|turn|>system\nS<|end|>\n" + "<|turn|>assistant\nhi<|end|>\n" * 2
    assert [r["rendered"][s["start"] : s["end"]] for s in r["spans"]] == ["hi<|end|>"] * 2


def test_decontaminate(spark, docs):
    items = [(1, PASSAGE), (2, text(40)), (3, None), (4, ""), (5, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    near = edited(PASSAGE, 8)
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(900, text(50) + " " + near + " " + text(50))], "doc_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate(more, bench).collect()}
    assert {d for d, i in got if i == 1} == {6, 7, 8, 900} and not {d for d, i in got if i == 2}
    assert got[7, 1]["score"] == 1.0 and (got[7, 1]["start"], got[7, 1]["end"]) == (20, 80)
    a, b = np.array([1, 2, 3, 4]), np.array([9, 1, 2, 8, 3, 4, 9])
    assert align(a, b) == (4 * MATCH - 1, 6)


def test_decontaminate_edited_copies(spark):
    items = [(k, text(40)) for k in range(20)]
    rows = []
    for k, t in items:
        for first in range(4):
            w = t.split()
            w[first::4] = [f"edit{k}x{first}x{j}" for j in range(len(w[first::4]))]  # every fourth word
            rows.append((4 * k + first, f"{text(30)} {' '.join(w)} {text(30)}"))
    got = decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(d, d // 4) for d in range(80)]


def plain_templates(texts, depth=2, min_docs=8, similarity=0.75, counts=False):
    """Which lines of each text recur, by counting in dictionaries."""
    def mask(token):
        return "#" if any(c in "0123456789" for c in token) else token

    split = [[[mask(x) for x in line.split()] for line in t.split("\n")] if t is not None else [] for t in texts]
    count = Counter((len(w), *w[:depth], p, w[p]) for lines in split for w in lines for p in range(depth, len(w)))

    def template(w):
        seen = [math.inf if p < depth else count[(len(w), *w[:depth], p, w[p])] for p in range(len(w))]
        seen = [n if n >= min_docs else 0 for n in seen]
        if not w or set(w) == {"#"}:
            return None
        level = sorted(seen, reverse=True)[math.ceil(len(w) * similarity) - 1]
        if not level:
            return None
        return (len(w), *(x if p < depth or n and n >= (n if level == math.inf else level / 2) and (level < math.inf or n == math.inf) else None for p, (x, n) in enumerate(zip(w, seen, strict=True))))

    named = [[template(w) for w in lines] for lines in split]
    docs = Counter(t for lines in named for t in set(lines) if t)
    recurring = [[t is not None and docs[t] >= min_docs for t in lines] for lines in named]
    return (recurring, named, docs) if counts else recurring


def check_templates(spark, texts):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in line_templates(spark.createDataFrame(rows, "doc_id long, text string, chunk string, bucket int")).collect()}
    for i, again in enumerate(plain_templates(texts)):
        kept = None if texts[i] is None else "\n".join(x for x, r in zip(texts[i].split("\n"), again, strict=True) if not r)
        assert (got[i]["text"], got[i]["n_lines"], got[i]["n_recurring"], got[i]["n_dropped"]) == (kept, len(again), sum(again), sum(again))
    return got


def test_line_templates(spark, none):
    rows = [(i, f"Page {i} of 90 in all\n{text(30)}\n{text(40)}\nThe quick brown fox sees {R.choice(WORDS)} every day now") for i in range(12)]
    rows += [(100 + i, "a b c d e f\ng h i j k l") for i in range(12)] + [(200, None), (201, ""), (None, text(9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_templates(docs).collect()}
    for i in range(12):
        assert got[i]["text"] == "\n".join(rows[i][1].split("\n")[1:3]) and got[i]["n_dropped"] == 2
        assert got[100 + i]["text"] == "" and got[100 + i]["n_dropped"] == 2  # nothing is exempt
    assert got[200]["text"] is None and got[201]["text"] == ""
    got = {r["doc_id"]: r for r in line_templates(docs, copies=(75, 100)).collect()}
    for i in range(12):
        assert got[i]["n_dropped"] == 2
        assert got[100 + i]["text"] == rows[12 + i][1] and got[100 + i]["n_recurring"] == 2  # a copy is left whole where that is asked for
    assert line_templates(none).count() == 0 and line_templates(none, copies=(75, 100)).count() == 0


def test_line_templates_against_counts(spark):
    r = random.Random(8)
    def pick(n):
        return r.choice(WORDS[:n])

    frames = [(20, "Written by"), (9, "Seen on"), (4, "Read at")]
    texts = [None, "", " \n\t", "12 13\n7", "one", *["12 13", "7"] * 9, *["Share this"] * 8, *["Too few"] * 7]
    for n, words in frames:
        rest = [pick(200) for _ in range(20)]
        for k in range(n):
            own = list(rest)
            for p in (2, 7, 12):  # three fields, one of them of few values
                own[p] = WORDS[k % 3] if p == 2 else pick(400)
            texts.append(f"{text(12)}\n{words} {' '.join(own)} in {1900 + k}\n{text(6)}\n{words} {' '.join(own)} in {1900 + k}")
    for k in range(30):  # nodes that several templates and other lines share
        texts.append("\n".join(" ".join(["the", "old", *(pick(4) for _ in range(6))]) for _ in range(3)))
    got = check_templates(spark, texts)
    found = sum(r["n_dropped"] == 2 for r in got.values())
    assert found >= 29  # both long frames
    check_templates(spark, ["same words in every line"] * 9 + [text(50)])


def test_line_templates_of_most_of_a_document(spark):
    often = text(30)
    rows = [(i, f"{often}\n{text(20)}") for i in range(12)] + [(50, often)]  # 60% boilerplate; nothing but boilerplate
    base = "\n".join(text(25) for _ in range(4))
    rows += [(100 + i, base.replace(base.split()[7 + i], "edit", 1)) for i in range(12)]  # near copies
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_templates(docs, copies=(75, 100)).collect()}
    for i in range(12):
        assert got[i]["text"] == rows[i][1].split("\n")[1] and (got[i]["n_recurring"], got[i]["n_dropped"]) == (1, 1)
        assert got[100 + i]["text"] == rows[13 + i][1] and got[100 + i]["n_recurring"] >= 3 and got[100 + i]["n_dropped"] == 0
    assert got[50]["text"] == "" and got[50]["n_dropped"] == 1
    rows = [(i, f"{often}\n{text(20)}") for i in range(12)] + [(200 + i, f"{often}\n{base}") for i in range(9)] + [(300, "")]
    got = {r["doc_id"]: r for r in line_templates(spark.createDataFrame(rows, "doc_id long, text string"), copies=(75, 100)).collect()}
    for i in range(9):  # copies lose what others have, too, and keep their own lines
        assert (got[200 + i]["text"], got[200 + i]["n_recurring"], got[200 + i]["n_dropped"]) == (base, 5, 1)
    assert all(r["n_dropped"] == r["n_recurring"] for r in line_templates(docs).collect())


def test_toxic_spans(spark, none):
    bad = ["blorg", "snarfing", "snarfed", "snarfs"]
    rows = [(f"{text(20)} " + (f"{R.choice(bad)} {R.choice(bad)} {text(5)}" if k % 5 == 0 else text(7)), int(k % 5 == 0)) for k in range(300)]
    model = fit([t for t, _ in rows], [y for _, y in rows])
    fresh = [(0, "all is well"), (1, "you snarfy blorg and snarfle"), (2, None), (3, "")]
    got = {r["doc_id"]: r for r in toxic_spans(spark.createDataFrame(fresh, "doc_id long, text string"), model).collect()}
    assert [got[k]["predicted"] for k in range(4)] == [0, 1, 0, 0]
    assert any(fresh[1][1][s["start"] : s["end"]] == "blorg" for s in got[1]["spans"])
    assert toxic_spans(none, fit([], [])).count() == 0


def test_pipeline_runs(spark):
    corpus = pytest.importorskip("corpus_pipeline")
    assert [k for k, _ in corpus.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "packing"]


def test_pipeline_keeps_one_row_of_near_duplicates(spark):
    corpus = pytest.importorskip("corpus_pipeline")
    a, b, c = text(60), text(60), text(60)
    near = a + " " + text(1)
    rows = [(3, a), (2, near), (None, a), (5, b), (5, b), (None, c), (None, c), (7, ""), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus.near_duplicates(spark, docs, "").collect()]
    want = [(2, near), (5, b), (None, c), (7, ""), (None, None), (None, "")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
