"""Operators without SQL, and the stages of the pipeline, against plain versions; and the cases that every operator must stand."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from test_operators import WORDS, plain_templates

from subgrove.llm import simple8b as S
from subgrove.llm import toxic_spans as T
from subgrove.llm.chat_rotation import perspective_rotation
from subgrove.llm.decontamination import decontaminate
from subgrove.llm.line_templates import line_templates
from subgrove.llm.ngram_jaccard import ngram_jaccard
from subgrove.llm.quality_rules import ledger
from subgrove.llm.stupid_backoff import stupid_backoff
from subgrove.llm.substring_dedup import substring_dedup
from subgrove.llm.vector_packing import Bin, best_fit_packing, plan

R = random.Random(23)
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def text(n, r=R):
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(t, every, r=R):
    """A copy in which one word of so many is another, at least two apart."""
    w = t.split()
    for k in range(r.randrange(every), len(w), every):
        w[k] = r.choice(WORDS)
    return " ".join(w)


def token_ids(name, texts, end):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path(name))
    return [[*e.ids, end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ODD = [None, "", " \n\t ", "one", "A, b.\nC d, e.", "tab\there  two", "naïve café — 漢字 <|endoftext|> x", "x " * 5000, text(400), "\n", "İstanbul ŋ", "a\x00b"]


# best-fit packing


def check_packing(rows, docs, most=2048):
    """rows: what packing returned; docs: (doc_id, text), in any order."""
    want = Counter()
    for (doc, _), ids in zip(docs, token_ids("byte_bpe_50k.json", [t for _, t in docs], 0), strict=True):
        at, k = 0, 0
        while at < len(ids):
            n = (len(ids) % most or most) if k == 0 else most
            want[doc, k, at, n, crc(ids[at : at + n])] += 1
            at, k = at + n, k + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in bins.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= most
    return bins


def test_packing_contract(spark):
    public = pytest.importorskip("public_tokenizers")
    rows = [(k, t, 1) for k, t in enumerate(ODD)] + [(None, "x y", 1), (None, "x y", 1), (3, "one", 1), (3, "one", 1)] + [(100 + k, text(R.randint(1, 300)), 1) for k in range(60)]
    got = best_fit_packing(spark.createDataFrame(rows, "doc_id long, text string, piece int"), public.path("byte_bpe_50k.json")).collect()
    bins = check_packing(got, [(i, t) for i, t, _ in rows])
    assert len(bins) <= math.ceil(sum(r["length"] for r in got) / 2048) + 1


def plain_packing(lengths, cap, weights):
    """One piece after the other, longest first, each where the weighted norm of what is left becomes least."""
    bins = []
    for n in sorted(lengths, reverse=True):
        need, best = (n, 1, n * n), None
        for k, room in enumerate(bins):
            if all(x >= y for x, y in zip(room, need, strict=True)):
                norm = sum(((x - y) * w / c) ** 2 for x, y, w, c in zip(room, need, weights, cap, strict=True))
                if best is None or norm < best[0]:
                    best = (norm, k)
        if best is None:
            bins.append(cap)
        k = len(bins) - 1 if best is None else best[1]
        bins[k] = tuple(x - y for x, y in zip(bins[k], need, strict=True))
    return sorted(bins)


@pytest.mark.parametrize("cap", [(100, 3, 4000), (100, 100, 3000), (100, 2, 10_000), (64, 5, 1500)])
def test_plan_of_binding_capacities_is_best_fit(cap):
    r = random.Random(sum(cap))
    most = min(cap[0], math.isqrt(cap[2]))
    lengths = [r.randint(1, most) for _ in range(150)]
    own = Bin(*cap, weights=(1.0, 0.5, 0.7))
    room = {}
    for length, _, n, each, first, offset in plan(dict(Counter(lengths)), own).tolist():
        for j in range(n):
            tokens, docs, attention = room.get(first + j // each, cap)
            assert cap[0] - tokens == offset + j % each * length
            room[first + j // each] = (tokens - length, docs - 1, attention - length * length)
    assert min(min(x) for x in room.values()) >= 0
    assert sorted(room.values()) == plain_packing(lengths, cap, own.weights)


# token files


def test_token_files_contract(spark):
    public = pytest.importorskip("public_tokenizers")
    rows = [(k, t) for k, t in enumerate(ODD)] + [(5, "another text of one id"), (5, "another text of one id"), (None, "x"), (None, "y z")] + [(50 + k, text(R.randint(0, 200))) for k in range(200)]
    R.shuffle(rows)
    path = S.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), public.path("word_bpe_49k.json"), 2)
    got = sorted(S.read_token_files(spark, path, with_ids=False).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    ids = token_ids("word_bpe_49k.json", [t for _, t in rows], 2)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(x), crc(x)) for (i, _), x in zip(rows, ids, strict=True))


# decontamination


def plain_alignment(item, own):
    """Smith-Waterman in full: match 2, mismatch and gap -1."""
    best, above = 0, [0] * (len(own) + 1)
    for x in item:
        row = [0]
        for k, y in enumerate(own):
            row.append(max(0, above[k] + (2 if x == y else -1), above[k + 1] - 1, row[k] - 1))
        best, above = max(best, *row), row
    return best


def plain_contaminated(docs, items, threshold=0.5):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = []
    for i, t in docs:
        for k, x in items:
            a, b = (x or "").translate(low).split(), (t or "").translate(low).split()
            if a and b and (score := plain_alignment(a, b) / (2 * len(a))) >= threshold:
                found.append((i, k, round(score, 9)))
    return found


def test_decontamination_against_all_pairs(spark):
    r = random.Random(6)
    items = [(k, text(r.randint(12, 30), r)) for k in range(8)] + [(8, None), (9, ""), (10, "two words"), (11, text(5, r)), (12, "Ä b C d")]
    items += [items[0], (None, items[1][1])]
    docs = [(k, text(r.randint(0, 60), r)) for k in range(12)]
    for k, (_, x) in enumerate(items):
        if x:
            docs.append((100 + k, f"{text(9, r)} {x.upper()}\n{text(4, r)}"))
            w = x.split()
            if len(w) >= 12:  # edits of an item of one or two seeds may leave none of them
                docs += [(200 + 10 * k + e, f"{text(7, r)} {edited(x, e, r)} {text(7, r)}") for e in (5, 7)]
                docs.append((400 + k, " ".join([*w[: len(w) // 2], text(3, r), *w[len(w) // 2 :]])))  # words put in
            docs.append((500 + k, " ".join(w[: len(w) // 3])))  # too little of it
    docs += [docs[-1], docs[14], (None, items[2][1]), (None, items[2][1]), (700, None), (701, ""), (702, f"{text(3000, r)} {items[3][1]} {items[4][1]} {text(2000, r)}")]
    got = decontaminate(spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, score int"), spark.createDataFrame([(k, x, "z") for k, x in items], "item_id long, text string, doc_id string"))
    assert Counter((x["doc_id"], x["item_id"], round(x["score"], 9)) for x in got.collect()) == Counter(plain_contaminated(docs, items))
    for a, b in (([], items), (docs, [])):
        assert decontaminate(spark.createDataFrame(a, "doc_id long, text string"), spark.createDataFrame(b, "item_id long, text string")).count() == 0


# toxicity


def plain_marginals(model, tokens):
    """Forward and backward sums over one text, state by state."""
    step = np.exp(np.array(model.chain))
    own = [np.array([1.0, math.exp(model.bias + model.emission(t))]) for t in tokens]
    up, down = [own[0] / own[0].sum()], [np.ones(2)]
    for e in own[1:]:
        x = up[-1] @ step * e
        up.append(x / x.sum())
    for e in own[:0:-1]:
        x = step @ (e * down[-1])
        down.append(x / x.sum())
    both = np.array(up) * np.array(down[::-1])
    return both[:, 1] / both.sum(axis=1)


def plain_score(model, t):
    tokens = T._TOKEN.findall(t or "")
    p = plain_marginals(model, tokens) if tokens else np.zeros(1)
    a, b, c = model.score
    return 1 / (1 + math.exp(-(a + b * math.log1p((p * p).sum()) + c * p.max())))


def test_toxic_scores_and_spans_against_plain_recursions(spark):
    model = T.Model({"bad": 4.0, "bads*": 3.0, "wors*": 2.5, "fine": -2.0}, -3.0, ((0.4, -1.0), (-0.6, 0.8)), (-4.0, 2.0, 3.0))
    r = random.Random(5)
    texts = [None, "", "123", "bad", "BAD badstuff fine", *(" ".join(r.choice(["bad", "badsome", "worse", "fine", *WORDS]) for _ in range(n)) for n in (1, 2, 63, 64, 65, 128, 129, 700))]
    rows = [(k, t, 0.5) for k, t in enumerate(texts)] + [(None, "bad", 0.5), (None, "bad", 0.5), (3, "bad", 0.5)]
    got = T.toxic_spans(spark.createDataFrame(rows, "doc_id long, text string, score double"), model).collect()
    assert len(got) == len(rows)
    by = {x["doc_id"]: x for x in got}
    for k, t in enumerate(texts):
        assert abs(by[k]["score"] - plain_score(model, t)) < 1e-9 and by[k]["predicted"] == int(by[k]["score"] >= 0.3)
        where = [m.span() for m in T._TOKEN.finditer(t or "")]
        p = plain_marginals(model, T._TOKEN.findall(t)) if where else []
        assert [(s["start"], s["end"], round(s["marginal"], 9)) for s in by[k]["spans"]] == [(*w, round(x, 9)) for w, x in zip(where, p, strict=True) if x >= 0.5]
    assert by[None]["score"] == by[3]["score"]


def test_training_is_bounded_and_reads_no_other_rows(spark):
    rows = [(k, f"snarf blorg {text(8)}" if k % 4 == 0 else text(10)) for k in range(200)] + [(None, "snarf"), (7, "repeated")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0), "x") for k in range(200)] + [(None, 1, "x"), (5, None, "x")], "doc_id long, toxic int, text string")
    model = T.train(docs, labels)
    again = T.train(docs.repartition(7), labels)
    assert again.weights == pytest.approx(model.weights) and again.score == pytest.approx(model.score) and model.emission("snarf") > 0
    few = T.train(docs, labels, max_bytes=3000)
    assert few.score != pytest.approx(model.score) and T.train(docs, labels, max_bytes=0).weights == {}
    assert T.train(docs.limit(0), labels).weights == {} and T.train(docs, labels.limit(0)).weights == {}


# every operator


def plain_copies(texts, num=75, den=100):
    """Of each text, the least place of a text that it is linked with by links."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))
    for _ in sets:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if x and den * len(x & y) >= num * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
    return root


def test_long_texts_and_clashing_columns(spark):
    long = text(60_000)
    rows = [(1, long, 1, 2, 3.0), (2, long, 1, 2, 3.0), (3, text(30), 1, 2, 3.0), (4, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk long, rep int, n_words double")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup(docs).collect()} == {1: 60_000, 2: 60_000, 3: 0, 4: 0}
    assert {r["doc_id"]: r["component_id"] for r in ngram_jaccard(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r["doc_id"]: r["n_words"] for r in stupid_backoff(docs).collect()} == {1: 60_000, 2: 60_000, 3: 30, 4: 0}
    assert {r["doc_id"]: r["n_words"] for r in ledger(docs).collect()} == {1: 60_000, 2: 60_000, 3: 30, 4: 0}
    assert {r["doc_id"]: r["n_dropped"] for r in line_templates(docs, min_docs=2).collect()} == {1: 1, 2: 1, 3: 0, 4: 0}


def test_rotation_of_odd_dialogues(spark):
    turns = [(1, k, f"speaker {k % 3}", text(3), 0) for k in range(1500)] + [(None, 5, "a", "x", 0), (None, 5, "a", "x", 0), (None, 1, "system", "y", 0), (2, None, "b", "", 0), (2, None, "b", "", 0)]
    schema = "conv_id long, turn long, role string, text string, place int"
    got = perspective_rotation(spark.createDataFrame(turns, schema)).collect()
    whole = [r for r in got if r["conv_id"] == 1]
    assert len(whole) == 3 and all((r["n_turns"], len(r["spans"]), r["chunk"]) == (1500, 500, 0) for r in whole)  # no dialogue is cut
    assert [(r["n_turns"], r["rendered"]) for r in got if r["conv_id"] is None] == [(1, "<|turn|>assistant\nx<|end|>\n")] * 2
    assert [r["n_turns"] for r in got if r["conv_id"] == 2] == [2]
    for r in got:
        assert all(r["rendered"][s["start"] : s["end"]].endswith("<|end|>") for s in r["spans"])
    cut = perspective_rotation(spark.createDataFrame(turns, schema), turns_per_chunk=500)
    assert sorted(r["chunk"] for r in cut.collect() if r["conv_id"] == 1) == [0] * 3 + [1] * 3 + [2] * 3
    assert perspective_rotation(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("bits", [13, 16])
def test_exchange_through_relays(spark, monkeypatch, bits):
    """Many small chunks and buckets, with and without relays, give the same counts."""
    from subgrove.llm import exchange as X

    r = random.Random(bits)
    rows = [(k, " ".join(r.choice(WORDS[:40]) for _ in range(r.randint(0, 90)))) for k in range(80)] + [(k, None) for k in range(80, 90)]
    rows += [(100 + k, rows[k][1]) for k in range(0, 60, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ask = lambda: (Counter(map(tuple, stupid_backoff(docs).collect())), Counter((x["doc_id"], x["n_removed"], x["kept_text"]) for x in substring_dedup(docs).collect()), Counter(map(tuple, line_templates(docs, min_docs=2).collect())))
    want = ask()
    chunked = X.chunked
    for module in ("stupid_backoff", "substring_dedup", "line_templates"):
        monkeypatch.setattr(f"subgrove.llm.{module}.X.chunked", lambda *a, **k: chunked(*a[:1], 23 * X.CHUNK_BYTES, *a[2:5], chunk_bytes=X.CHUNK_BYTES))
        monkeypatch.setattr(f"subgrove.llm.{module}.X.buckets", lambda size: bits)
    assert X.near(bits) < bits
    got = ask()
    assert got[1:] == want[1:]
    assert sorted((x[0], x[1], round(x[2], 9), *x[4:]) for x in got[0]) == sorted((x[0], x[1], round(x[2], 9), *x[4:]) for x in want[0])


def test_words_in_place():
    """Words, hashes, digits and lines read from bytes are those of split(); keys are found as by a dictionary."""
    import pyarrow as pa

    from subgrove.llm import exchange as X
    from subgrove.llm.line_templates import Lines
    from subgrove.llm.text import hashed, hashed_in_place, raw_bytes, strings, word_places

    r = random.Random(8)
    parts = ["a", "b1", "7", "\n", " ", "\t", "\r\n", "\x0b", "\x0c", "é", "漢", "\x85", "\u2003", "x" * 70, "y" * 64 + "3", " " * 90, "\n\n"]
    cases = [["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(r.randrange(7))] for _ in range(300)]
    cases += [[], [None], ["", "\n", ""], ["w " * 40_000 + "z" * 100_000, None, "k"], [text(20_000, r)]]
    for texts in cases:
        raw, at = raw_bytes(strings(texts))
        first, end = word_places(raw, at)
        words = [w for t in texts for w in (t or "").encode().split()]
        assert [raw[s:e].tobytes() for s, e in zip(first, end, strict=True)] == words
        names, digit = hashed_in_place(raw, first, end)
        assert (names == hashed(pa.array([w.decode() for w in words], pa.string()))).all()
        assert digit.tolist() == [any(48 <= c <= 57 for c in w) for w in words]
        lines = Lines(texts, 2)
        assert lines.counts.tolist() == [len(x.encode().split()) for t in texts for x in (t or "").split("\n")]
        assert np.diff(lines.at).tolist() == [(t or "").count("\n") + 1 for t in texts]
    keys = np.random.default_rng(8).integers(0, 1 << 64, 3000, np.uint64)
    for known in (keys[:0], keys[:1], np.sort(keys[:2000]), np.sort(np.r_[keys[:500], keys[:500] + np.uint64(1)])):
        where = {int(k): n + 1 for n, k in enumerate(known)}
        assert X.look_up(keys, known, np.arange(1, len(known) + 1, dtype=np.uint64)).tolist() == [where.get(int(k), 0) for k in keys]
        assert X.look_up(keys, known).tolist() == [int(k) in where for k in keys]


def test_many_chunks_in_few_partitions_of_shuffled_rows(spark, monkeypatch):
    """50 chunks in 4 partitions give the rows that one gives; rows that come out of a shuffle are written first."""
    from subgrove.llm import exchange as X

    r = random.Random(50)
    rows = [(k, text(r.randint(0, 120), r)) for k in range(120)]
    rows += [(200 + k, rows[k][1]) for k in range(0, 90, 3)] + [(300, None), (None, ""), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rounded = lambda x: tuple(round(v, 9) if isinstance(v, float) else v for v in x)
    ops = (stupid_backoff, lambda d: substring_dedup(d).select("doc_id", "n_words", "n_removed", "kept_text"), lambda d: line_templates(d, min_docs=2), ngram_jaccard)
    ask = lambda d: [Counter(map(rounded, op(d).collect())) for op in ops]
    want = ask(docs)
    chunked = X.chunked
    seen = []

    def many(docs, size, *a, **k):
        seen.append(chunked(docs, 50 * X.CHUNK_BYTES, *a[:3], chunk_bytes=X.CHUNK_BYTES))
        return seen[-1]

    monkeypatch.setattr(X, "PARTITIONS", 4)
    monkeypatch.setattr(X, "chunked", many)
    assert X.settled(docs) is docs
    assert "Exchange" not in X.settled(docs.repartition(3))._jdf.queryExecution().executedPlan().toString()
    assert ask(docs.repartition(3)) == want
    assert all(d.select("chunk").distinct().count() > 40 and d.rdd.getNumPartitions() <= 4 for d in seen)


# the pipeline


def fixture():
    r = random.Random(31)
    bad = ["snarf", "blorg", "grumfle"]
    rows = []
    for k in range(120):
        own = text(r.randint(30, 60), r)
        rows.append((k, f"{own} {' '.join(r.choice(bad) for _ in range(4))} {text(5, r)}" if k % 5 == 0 else own))
    base = [text(12, r) for _ in range(4)]
    rows += [(200 + k, f"Written for part {k} of the series\n{text(25, r)}\n{text(20, r)}") for k in range(10)]
    rows += [(300 + k, "\n".join([*base[:3], base[3] if k < 8 else edited(base[3], 12, r)])) for k in range(10)]  # copies
    items = [(k, text(20, r)) for k in range(3)] + [(7, None)]
    rows += [(400, f"{text(20, r)} {items[0][1]} {text(9, r)}"), (401, f"{text(20, r)}\n{edited(items[1][1], 8, r)}")]
    rows += [(410, text(30_000, r))]  # very long
    rows += [(None, text(30, r)), (None, None), (None, "")] + [(500, "a text of a repeated row " + items[2][1][:9])] * 2 + [(501, None), (502, "")]
    return [(i, t, None if i == 3 else "en", "s", len(t or "")) for i, t in rows], items


def test_stages_and_run_against_plain_versions(spark, tmp_path):
    corpus, _ = pytest.importorskip("corpus_pipeline"), pytest.importorskip("public_tokenizers")
    rows, items = fixture()
    labels = [(i, int(i % 5 == 0)) for i, *_ in rows if i is not None and i < 120]
    sf = str(tmp_path / "sf")
    spark.createDataFrame([(*x, 1.5) for x in rows], DOCUMENTS + ", gone double").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    stage = dict(corpus.STAGES)
    frame = lambda x: spark.createDataFrame(x, DOCUMENTS)
    out = lambda x: Counter(tuple(r) for r in x.collect())

    train = sorted((i, t, i % 5 == 0) for i, t, *_ in rows if i is not None and i < 120 and zlib.crc32(str(i).encode()) % 4 != 2)
    model = T.fit([t for _, t, _ in train], [int(y) for *_, y in train])
    clean = [x for x in rows if plain_score(model, x[1]) < 0.3]
    assert all(x[0] is None or x[0] >= 120 or x[0] % 5 for x in clean) and len(clean) >= len(rows) - 24
    assert out(stage["toxicity"](spark, frame(rows), sf)) == Counter(clean)

    texts = [t for _, t, *_ in clean]
    (lines, named, docs), less = plain_templates(texts, counts=True), []
    open_ = []
    for k, (t, again) in enumerate(zip(texts, lines, strict=True)):
        sizes = [len(x.split()) for x in t.split("\n")] if t else []
        open_.append(sum(n for n, a in zip(sizes, again, strict=False) if a) > 0.5 * sum(sizes) if any(again) else False)
    root = plain_copies([t if o else None for t, o in zip(texts, open_, strict=True)])
    inside = Counter((root[k], t) for k, own in enumerate(named) if open_[k] for t in set(own))
    lines = [[a and (not open_[k] or docs[t] - inside[root[k], t] + 1 >= 8) for a, t in zip(again, named[k], strict=True)] for k, again in enumerate(lines)]
    for k, (x, again) in enumerate(zip(clean, lines, strict=True)):
        if not any(again):
            less.append(x)
        else:
            t = "\n".join(y for y, a in zip(x[1].split("\n"), again, strict=True) if not a)
            less.append((x[0], t, *x[2:4], len(t)))
    assert any(len(x[1] or "") < len(y[1] or "") for x, y in zip(less, clean, strict=True))
    assert out(stage["line_dedup"](spark, frame(clean), sf)) == Counter(less)

    root, first = plain_copies([t for _, t, *_ in less]), {}
    for k, c in enumerate(root):
        i = less[k][0]
        first[c] = min(first.get(c, (True, 0, k)), (i is None, i or 0, k))
    kept = [less[k] for _, _, k in sorted(first.values(), key=lambda x: x[2])]
    assert out(stage["ngram_jaccard"](spark, frame(less), sf)) == Counter(kept)

    gone = {i for i, *_ in plain_contaminated([(i, t) for i, t, *_ in kept], items)}
    rest = [x for x in kept if x[0] not in gone]
    assert {400, 401} <= gone
    assert out(stage["decontamination"](spark, frame(kept), sf)) == Counter(rest)

    check_packing(stage["packing"](spark, frame(rest), sf).collect(), [x[:2] for x in rest])
    check_packing(corpus.run(spark, sf).collect(), [x[:2] for x in rest])


def test_stages_of_odd_tables(spark, tmp_path):
    corpus, _ = pytest.importorskip("corpus_pipeline"), pytest.importorskip("public_tokenizers")
    sf = str(tmp_path / "sf")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    odd = [(None, None, None, None, None), (None, "", None, None, 0), (1, " \n ", "en", None, 3), (1, "x y", "en", "s", None), (1, "x y", "en", "s", None)]
    for rows in ([], odd):
        for name, stage in corpus.STAGES:
            got = stage(spark, spark.createDataFrame([(*x, 1, 2) for x in rows], DOCUMENTS + ", chunk int, row int"), sf)
            if name != "packing":
                assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert got.count() == len(rows) - (name == "ngram_jaccard" and len(rows) > 0)


def test_sets_of_one_name_are_told_apart(spark):
    from subgrove.llm.components import Scratch
    from subgrove.llm.ngram_jaccard import _classes

    rows = [(1, 9, 16, 5, b"a", b"x"), (2, 9, 16, 5, b"a", b"x"), (3, 9, 16, 6, b"b", b"y"), (4, 8, 16, 6, b"c", b"z"), (5, 9, 32, 5, b"d", b"w"), (6, 0, None, None, None, None)]
    got = _classes(spark.createDataFrame(rows, "doc_id long, n_shingles long, rep long, name long, shared binary, often binary"), Scratch()).collect()
    assert len({r["rep"] for r in got}) == 4 and {(r["first"], bytes(r["shared"]), r["least"]) for r in got} == {(16, b"a", 1), (16, b"b", 3), (16, b"c", 4), (32, b"d", 5)}
