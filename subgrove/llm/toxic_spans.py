"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import exchange as X
from .text import tidy

_TOKEN = re.compile(r"[^\W\d_]+")
#: Tokens of a row in which the recursions of many texts go side by side.
_ROW = 64


def features(token: str) -> list[str]:
    """The word itself and its beginnings, lower-cased."""
    word = token.lower()
    return [word, *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) >= n)]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Sequences:
    """Texts one after another (text k at at[k]:at[k + 1]), laid out so that recursions over all of them are done
    place by place: in rows of _ROW tokens, each row of one text."""

    def __init__(self, at: np.ndarray):
        self.at, lengths = at, np.diff(at)
        rows = -(-lengths // _ROW)
        self.size, self.rows, self.first = int(at[-1]), rows, np.cumsum(rows) - rows
        self.width = int(rows.sum())
        text = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(self.size) - at[text]
        self.cell = place % _ROW * self.width + self.first[text] + place // _ROW
        self.back = at[text + 1] - 1 - place  # the same text from its end
        if self.size < 1 << 30:
            self.cell, self.back = self.cell.astype(np.int32), self.back.astype(np.int32)
        self.begins = place == 0
        self.heads = np.zeros(self.width, bool)
        self.heads[self.first[rows > 0]] = True

    def forward(self, gain: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Of each token, the odds of state 1 against state 0 by all tokens up to it. gain: exp of its own log-odds."""
        own = np.ones((_ROW, self.width))
        own.reshape(-1)[self.cell] = gain
        (s00, s01), (s10, s11) = step
        if self.rows.max(initial=0) > 1:
            # what a row makes of either state before it
            a0, a1, b0, b1 = np.ones(self.width), np.zeros(self.width), np.zeros(self.width), np.ones(self.width)
            for k in range(_ROW):
                a0, a1, b0, b1 = s00 * a0 + s10 * a1, own[k] * (s01 * a0 + s11 * a1), s00 * b0 + s10 * b1, own[k] * (s01 * b0 + s11 * b1)
                if k == 0:
                    a0, b0 = np.where(self.heads, 1.0, a0), np.where(self.heads, 1.0, b0)
                    a1, b1 = np.where(self.heads, own[0], a1), np.where(self.heads, own[0], b1)
                if k % 4 == 3:
                    scale = a0 + a1 + b0 + b1
                    a0, a1, b0, b1 = a0 / scale, a1 / scale, b0 / scale, b1 / scale
        before = np.ones(self.width)
        live, k = np.flatnonzero(self.rows > 1), 0
        while len(live):  # from row to row of every text
            row = self.first[live] + k
            before[row + 1] = (a1[row] + b1[row] * before[row]) / (a0[row] + b0[row] * before[row])
            k += 1
            live = live[self.rows[live] > k + 1]
        odds = np.empty_like(own)
        now = before
        for k in range(_ROW):
            now = own[k] * (s01 + s11 * now) / (s00 + s10 * now)
            if k == 0:
                now = np.where(self.heads, own[0], now)
            odds[k] = now
        return odds.reshape(-1)[self.cell]

    def both(self, gain: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Odds by all tokens up to each, and from each on; both hold its own gain."""
        return self.forward(gain, step), self.forward(gain[self.back], step.T)[self.back]


def _exp(x):
    return np.exp(np.clip(x, -40, 40))


@dataclass(frozen=True)
class Model:
    """Weights of features, bias and transition weights of the chain, and the calibration of document scores."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    chain: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))
    score: tuple[float, float, float] = (-3.0, 0.0, 0.0)

    def emission(self, token: str) -> float:
        """What a token adds to the log-odds of being toxic, beside the bias; 0 for most."""
        return sum(self.weights.get(f, 0.0) for f in features(token))

    def marginals(self, gains: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of every token, the probability of being toxic, given all tokens of its text."""
        if not len(gains):
            return np.zeros(0)
        own = _exp(self.bias + gains)
        up, down = Sequences(at).both(own, np.exp(np.array(self.chain)))
        odds = up * down / own
        return odds / (1 + odds)

    def document(self, total: np.ndarray, most: np.ndarray) -> np.ndarray:
        a, b, c = self.score
        return _sigmoid(a + b * np.log1p(total) + c * most)


def _selected(docs: list[np.ndarray], own: list[list[int]], n: int, toxic: np.ndarray, least_g: float = 20.0, least_ratio: float = 8.0) -> np.ndarray:
    """Which of n features mark toxic documents, by a likelihood-ratio test on the documents that have them. own: features by word."""
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    counts = np.zeros((2, n), np.int64)
    for words, y in zip(docs, toxic, strict=True):
        counts[int(y), list({f for w in np.unique(words).tolist() for f in own[w]})] += 1
    c, a = counts
    share, base = a / np.maximum(a + c, 1), n1 / (n1 + n0)
    g = 2 * (a * np.log(np.maximum(share, 1e-9) / base) + c * np.log(np.maximum(1 - share, 1e-9) / (1 - base)))
    return np.flatnonzero((a >= 3) & (g >= least_g) & ((a + 0.5) / (n1 + 1) >= least_ratio * (c + 0.5) / (n0 + 1)))


def _parts(words_of: np.ndarray, at: np.ndarray, y: np.ndarray, marked: dict[int, list[int]], has: np.ndarray, tokens: int = 100_000):
    """Texts in parts of about so many tokens: layout, which tokens have which features, and labels."""
    lengths = np.diff(at)
    edge = np.r_[0, np.flatnonzero(np.diff(at[:-1] // tokens)) + 1, len(lengths)]
    for s, e in zip(edge.tolist(), edge[1:].tolist(), strict=False):
        own = words_of[at[s] : at[e]]
        where = np.flatnonzero(has[own])
        few = [marked[w] for w in own[where].tolist()]
        place, feature = np.repeat(where, [len(x) for x in few]), np.array([f for x in few for f in x], np.int64)
        if len(own):
            yield Sequences(at[s : e + 1] - at[s]), place, feature, (has[own] & np.repeat(y[s:e], lengths[s:e])).astype(np.int8)


def _train_chain(parts: list, n_features: int, rounds: int = 80):
    """Maximum likelihood over whole texts with a small ridge, by Adam. A part at a time is in work, so that memory is
    bounded by it."""
    theta = np.zeros(n_features + 5)
    theta[n_features] = -3.0
    m = v = np.zeros_like(theta)
    n_texts = sum(len(texts.at) - 1 for texts, *_ in parts)
    for turn in range(1, rounds + 1):
        grad, step = np.zeros(n_features + 5), np.exp(theta[n_features + 1 :].reshape(2, 2))
        for texts, place, feature, labels in parts:
            own = _exp(theta[n_features] + np.bincount(place, theta[feature], texts.size))
            later = np.flatnonzero(~texts.begins)
            up, down = texts.both(own, step)
            odds = up * down / own
            miss = labels - odds / (1 + odds)
            f, r = up[later - 1], down[later]
            w10, w11, w01 = step[1, 0] * f, step[1, 1] * f * r, step[0, 1] * r
            total = step[0, 0] + w01 + w10 + w11
            expected = np.array([(step[0, 0] / total).sum(), (w01 / total).sum(), (w10 / total).sum(), (w11 / total).sum()])
            grad += np.r_[np.bincount(feature, miss[place], n_features), miss.sum(), np.bincount(2 * labels[later - 1] + labels[later], minlength=4) - expected]
        grad = grad / max(1, n_texts) - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + 0.2 * (1 - turn / rounds) ** 0.5 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return theta[:n_features], float(theta[n_features]), tuple(map(tuple, theta[n_features + 1 :].reshape(2, 2).tolist()))


def fit(texts: list[str | None], toxic: list[int]) -> Model:
    """A model from whole texts and their labels; without both labels, one that finds nothing.

    Tokens are labelled first: those of a toxic document that have a feature marking such documents.
    """
    y = np.array(toxic, bool)
    if not y.any() or y.all():
        return Model()
    words: dict[str, int] = {}
    names: dict[str, int] = {}
    docs = [np.fromiter((words.setdefault(t.lower(), len(words)) for t in _TOKEN.findall(x or "")), np.int32) for x in texts]
    bad = np.zeros(len(words), bool)
    for t, toxic_too in zip(docs, y, strict=True):
        if toxic_too:
            bad[t] = True
    for w, is_bad in zip(words, bad.tolist(), strict=True):  # a feature that no toxic document has can't be chosen
        if is_bad:
            for f in features(w):
                names.setdefault(f, len(names))
    own = [tuple(names[f] for f in features(w) if f in names) for w in words]
    chosen = _selected(docs, own, len(names), y).tolist()
    if not chosen:
        return Model()
    number = {f: k for k, f in enumerate(chosen)}
    marked = {w: few for w, fs in enumerate(own) if (few := [number[f] for f in fs if f in number])}
    spelt = list(names)
    chosen = [spelt[f] for f in chosen]
    spelt = list(words)
    tokens = docs
    del names, own
    at = np.r_[0, np.cumsum([len(t) for t in tokens])]
    words_of = np.concatenate(tokens)
    has = np.zeros(len(words), bool)
    has[list(marked)] = True
    weights, bias, chain = _train_chain(list(_parts(words_of, at, y, marked, has)), len(chosen))
    model = Model(dict(zip(chosen, weights.tolist(), strict=True)), bias, chain)
    gain = {w: model.emission(spelt[w]) for w in marked}
    by_word = np.zeros(len(words))
    by_word[list(gain)] = list(gain.values())
    edge = np.r_[0, np.flatnonzero(np.diff(at[:-1] // 100_000)) + 1, len(y)]
    each = [_totals(model.marginals(by_word[words_of[at[s] : at[e]]], at[s : e + 1] - at[s]), at[s : e + 1] - at[s]) for s, e in zip(edge, edge[1:], strict=False)]
    total, most = (np.concatenate(x) for x in zip(*each, strict=True))
    x = np.c_[np.ones(len(y)), np.log1p(total), most]
    c = np.zeros(3)
    for _ in range(50):  # Newton steps of a logistic regression with a ridge
        p = _sigmoid(x @ c)
        c = c + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3), x.T @ (y - p) - 0.05 * c)
    return Model(model.weights, bias, chain, tuple(c.tolist()))


def _gains(model: Model, texts: list[list[str]], cache: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    parts, at = [], [0]
    for own in texts:
        for w in own:
            if w not in cache:
                cache[w] = model.emission(w)
        parts.append(np.fromiter(map(cache.__getitem__, own), float, len(own)))
        at.append(at[-1] + len(own))
    return (np.concatenate(parts) if parts else np.zeros(0)), np.array(at)


def _totals(p: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the sum of its squared marginals, to which the many small ones of a long harmless text add next to
    nothing, and the largest marginal."""
    total, most = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        total[some], most[some] = np.add.reduceat(p * p, at[some]), np.maximum.reduceat(p, at[some])
    return total, most


def train(docs: DataFrame, labels: DataFrame, use: Column | None = None, max_toxic: int = 1000, max_other: int = 4000, max_bytes: int = 48 << 20, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """fit() on a bounded sample: of the labelled rows for which use holds, at most max_toxic and max_other, least hash
    of the id first, and of these as many whole texts, in the same order, as have at most max_bytes together. Repeated
    rows count once; rows of null id or label are not used."""
    rows = labels.select(F.col(id_col).alias("doc_id"), F.col("toxic")).where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows if use is None else rows.where(use)
    order = F.xxhash64(F.col("doc_id"), F.lit(7))
    few = rows.where("toxic = 1").orderBy(order, "doc_id").limit(max_toxic).unionByName(rows.where("toxic <> 1").orderBy(order, "doc_id").limit(max_other))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("tie"))
    sizes = texts.join(F.broadcast(few), "doc_id").select("doc_id", "tie", "toxic", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).distinct()
    first = sizes.where(F.col("bytes") <= max_bytes).orderBy(order, "doc_id", "tie", "toxic").limit(max_toxic + max_other)
    upto = F.sum("bytes").over(W.orderBy(order, "doc_id", "tie", "toxic").rowsBetween(W.unboundedPreceding, W.currentRow))
    chosen = first.withColumn("upto", upto).where(F.col("upto") <= max_bytes).select("doc_id", "tie", "toxic")
    sample = texts.join(F.broadcast(chosen), ["doc_id", "tie"]).groupBy("doc_id", "tie", "toxic").agg(F.first("text").alias("text")).toPandas().sort_values(["doc_id", "tie", "toxic"])
    model = fit(sample["text"].tolist(), [int(x == 1) for x in sample["toxic"]])
    del sample
    tidy()
    return model


def toxic_spans(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Scores whole texts: doc_id, score (0 to 1), predicted (1 if score >= threshold) and spans, the tokens
    whose marginal is 0.5 or more (places in characters, end exclusive, and the marginal).

    Marginals are those of the whole text: forward and backward recursions over every token, exact, however long it
    is. Texts without tokens, and null texts, get the score of a text without any toxic token. Only the text
    is an input. An empty table gives no rows. Rows of null id and repeated rows are scored like others. Columns named in carry are returned too.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def score(it):
        cache: dict[str, float] = {}
        for pdf in X.pieces(it, 500):
            if len(cache) > 500_000:
                cache = {}
            tokens = [_TOKEN.findall(t) if t else [] for t in pdf["text"]]
            gains, at = _gains(model, tokens, cache)
            p = model.marginals(gains, at)
            scores = model.document(*_totals(p, at))
            spans: list[list[dict]] = [[] for _ in range(len(pdf))]
            hit = np.flatnonzero(p >= 0.5)
            text = np.searchsorted(at, hit, side="right") - 1
            for k in sorted(set(text.tolist())):
                where = [m.span() for m in _TOKEN.finditer(pdf["text"].iloc[k])]
                for e in hit[text == k].tolist():
                    s, z = where[e - at[k]]
                    spans[k].append({"start": s, "end": z, "marginal": float(p[e])})
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": scores, "predicted": (scores >= threshold).astype(np.int32), "spans": spans}).assign(**{c: pdf[c].array for c in pdf if c.startswith("carry_")})

        tidy()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *X.carried(carry))
    schema = f"doc_id {kind}, score double, predicted int, spans array<struct<start:int,end:int,marginal:double>>{X.kinds(rows)}"
    return X.handed(rows.mapInPandas(score, schema), carry)
