"""A quality score of documents: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .components import Scratch
from .text import hashed, rolling, starts_within, strings, tidy, tokens

#: Statistics of a text, in order.
STATISTICS = (
    "log_words", "word_length", "word_spread", "upper", "digits", "symbols", "marks", "other_marks", "wide", "spaces", "log_lines", "line_words", "distinct",
    "same_as_before", "most_common", "repeated_five", "repeated_lines", "short_words", "marked_words", "capital_words", "letterless_words",
)
_LOWER, _UPPER, _DIGIT, _SPACE, _MARK, _SYMBOL, _OTHER, _WIDE, _KINDS = *range(8), 8
#: Scores are counted in so many steps before they are calibrated.
_STEPS = 2000


def _kinds() -> np.ndarray:
    """What each byte is."""
    out = np.full(256, _OTHER, np.int64)
    out[0x61:0x7B], out[0x41:0x5B], out[0x30:0x3A], out[0x80:] = _LOWER, _UPPER, _DIGIT, _WIDE
    out[[0x20, *range(0x09, 0x0E)]] = _SPACE
    out[list(b".,;:!?'\"()-")] = _MARK
    out[list(b"#*$%&|<>")] = _SYMBOL
    return out


_KIND = _kinds()


def _summed(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum over at[k]:at[k + 1], for each k."""
    sums = np.r_[0.0, np.cumsum(values, dtype=float)]
    return sums[at[1:]] - sums[at[:-1]]


def _repeats(keys: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each of n texts: distinct keys, how many places have a key found twice or more, and how often the commonest is found."""
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])]) if len(keys) else np.zeros(0, int)
    times, owner, most = np.diff(np.r_[first, len(keys)]), doc[first], np.zeros(n, np.int64)
    np.maximum.at(most, owner, times)
    return np.bincount(owner, minlength=n), np.bincount(owner, np.where(times > 1, times, 0), n), most


def statistics(texts) -> np.ndarray:
    """A row for each text, null ones as empty; every entry is finite. An empty text has zeros throughout."""
    own = strings(texts)
    n = len(own)
    raw_at = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(own.buffers()[2], np.uint8)[raw_at[0] : raw_at[-1]] if raw_at[-1] > raw_at[0] else np.zeros(0, np.uint8)
    size = np.diff(raw_at)
    kinds = np.bincount(np.repeat(np.arange(n) * _KINDS, size) + _KIND[raw], minlength=n * _KINDS).reshape(n, _KINDS)
    share = lambda count, of: count / np.maximum(of, 1)
    letters, bytes_ = kinds[:, _LOWER] + kinds[:, _UPPER], size

    distinct, places, at = tokens(own)
    words, doc = np.diff(at), np.repeat(np.arange(n), np.diff(at))
    lengths = pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(float)
    has = lambda pattern: pc.match_substring_regex(distinct, pattern).to_numpy(zero_copy_only=False).astype(float)
    over = lambda of_word: share(_summed(of_word[places], at), words)
    mean = over(lengths)
    names = hashed(distinct)[places]
    kept, _, most = _repeats(names, doc, n)
    same = np.r_[False, (names[1:] == names[:-1]) & (doc[1:] == doc[:-1])][: len(names)]
    five = np.flatnonzero(starts_within(at, 5))
    _, again, _ = _repeats(rolling(names, 5)[five], doc[five], n)

    lines = pc.split_pattern(own, "\n")
    line_at = np.asarray(lines.offsets, np.int64)
    line_at = line_at - line_at[0]
    flat = lines.flatten()
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(flat)), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(n), np.diff(line_at))[full]
    line_names = flat.filter(pa.array(full)).dictionary_encode().indices.to_numpy().astype(np.uint64)
    n_lines = np.bincount(owner, minlength=n)
    lines_kept, _, _ = _repeats(line_names, owner, n)
    out = np.c_[
        np.log1p(words), mean, np.sqrt(np.maximum(over(lengths * lengths) - mean * mean, 0)),
        share(kinds[:, _UPPER], letters), share(kinds[:, _DIGIT], bytes_), share(kinds[:, _SYMBOL], words), share(kinds[:, _MARK], words), share(kinds[:, _OTHER], words),
        share(kinds[:, _WIDE], bytes_), share(kinds[:, _SPACE], bytes_), np.log1p(n_lines), np.log1p(share(words, n_lines)), share(kept, words), share(_summed(same, at), words),
        share(most, words), share(again, np.maximum(words - 4, 0)), share(n_lines - lines_kept, n_lines), over((lengths <= 3).astype(float)),
        over(has("[!-/:-@\\[-`{-~]$")), over(has("^[A-Z]")), over(1 - has("[A-Za-z\\x{80}-\\x{10FFFF}]")),
    ]
    return np.where((words > 0)[:, None], out, 0.0)


@dataclass(frozen=True)
class Kernel:
    """The random features: cosines of random directions of the standardised statistics."""

    mean: np.ndarray
    spread: np.ndarray
    size: int = 128
    bandwidth: float = 6.0
    seed: int = 13
    clip: float = 5.0

    def __call__(self, statistics: np.ndarray) -> np.ndarray:
        """A row of features for each row, the last one constant. Products of any two rows approximate exp(-|x - y|^2 / (2 bandwidth^2))."""
        rng = np.random.default_rng(self.seed)
        turn, shift = rng.normal(size=(len(self.mean), self.size)) / self.bandwidth, rng.uniform(0, 2 * np.pi, self.size)
        x = np.clip((statistics - self.mean) / np.where(self.spread > 1e-12, self.spread, 1.0), -self.clip, self.clip)
        return np.c_[np.cos(x @ turn + shift) * np.sqrt(2 / self.size), np.ones(len(x))]


def isotonic(at: np.ndarray, weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing function nearest to total / weight at the ascending places at, by pooling adjacent violators.

    A pool is two knots, its first and its last place.
    """
    pools: list[list[float]] = []  # weight, total, first, last
    for x, w, t in zip(at.tolist(), weight.tolist(), total.tolist(), strict=True):
        pools.append([w, t, x, x])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            w, t, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + w, pools[-1][1] + t, pools[-1][2], last]
    knots = [(x, t / w) for w, t, first, last in pools for x in ((first, last) if last > first else (first,))]
    return np.array([x for x, _ in knots]), np.array([y for _, y in knots])


@dataclass(frozen=True)
class Scorer:
    """The kernel, the weights of its features, and the knots of the calibration; without weights, one score for all."""

    kernel: Kernel
    weights: np.ndarray | None
    knots: tuple[np.ndarray, np.ndarray]
    ridge: float = 0.0

    def __call__(self, statistics: np.ndarray) -> np.ndarray:
        raw = np.zeros(len(statistics)) if self.weights is None else _clipped(self.kernel(statistics) @ self.weights)
        return np.clip(np.interp(raw, *self.knots), 0.0, 1.0)


def _clipped(raw: np.ndarray) -> np.ndarray:
    return np.clip(raw, -0.5, 1.5)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns carried and the STATISTICS of each whole text, as columns of doubles."""

    def make(it: Iterator[pd.DataFrame]):
        for pdf in X.pieces(it):
            own = pd.DataFrame(statistics(pdf["text"]), columns=list(STATISTICS), index=pdf.index)
            yield pd.concat([pdf.drop(columns="text"), own], axis=1)
        tidy()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *X.carried(carry))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}{X.kinds(rows)}, " + ", ".join(f"{s} double" for s in STATISTICS)
    return rows.mapInPandas(make, schema)


def _learned(stats: DataFrame, labels: DataFrame, use: Column | None, id_col: str, label: str, folds: int) -> DataFrame:
    """The statistics of labelled ids, their label and fold: of several rows of an id, and of several labels, the mean."""
    own = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("double").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    own = (own if use is None else own.where(use)).groupBy("doc_id").agg(F.avg("y").alias("y"))
    rows = stats.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.avg(s).alias(s) for s in STATISTICS))
    return rows.join(own, "doc_id").select(F.pmod(F.xxhash64("doc_id"), F.lit(folds)).cast("int").alias("fold"), "y", *STATISTICS)


def _normal_equations(rows: DataFrame, kernel: Kernel, folds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each fold: features by features, features by label, and how many rows. Summed in each task, then by row over tasks."""
    m = kernel.size + 1

    def add(it: Iterator[pd.DataFrame]):
        sums = np.zeros((folds, m, m + 1))
        for pdf in it:
            x, y = kernel(pdf[list(STATISTICS)].to_numpy(float)), pdf["y"].to_numpy(float)
            for f in range(folds):
                mine = pdf["fold"].to_numpy() == f
                sums[f] += x[mine].T @ np.c_[x[mine], y[mine]]
        some = [(f * m + i, sums[f, i].tobytes()) for f in range(folds) if sums[f, -1, -2] for i in range(m)]
        yield pd.DataFrame(some, columns=["place", "sums"])

    def total(key, pdf):
        return pd.DataFrame({"place": [key[0]], "sums": [np.sum([np.frombuffer(x) for x in pdf["sums"]], axis=0).tobytes()]})

    out = np.zeros((folds, m, m + 1))
    for r in rows.mapInPandas(add, "place int, sums binary").groupBy("place").applyInPandas(total, "place int, sums binary").collect():
        out[r["place"] // m, r["place"] % m] = np.frombuffer(r["sums"])
    return out[:, :, :m], out[:, :, m], out[:, -1, m - 1]


def _solved(square: np.ndarray, right: np.ndarray, n: float, ridge: float) -> np.ndarray:
    """Ridge weights; the constant feature bears no penalty."""
    return np.linalg.solve(square + ridge * n * np.diag(np.r_[np.ones(len(right) - 1), 1e-9]), right)


def train_quality(stats: DataFrame, labels: DataFrame, use: Column | None = None, ridges: tuple[float, ...] = (1e-5, 1e-4, 1e-3, 1e-2), folds: int = 4, size: int = 128, id_col: str = "doc_id", label: str = "quality") -> Scorer:
    """Learns from all labelled ids for which use holds, whatever their number; what reaches the driver does not grow with it.

    stats: of measured(). Statistics are standardised by all its rows. Normal equations are summed by fold in the tasks. Less one fold's
    sums they give the model that scores this fold; these scores decide on the ridge (least squared error) and, in steps of 1 / 1000, are
    what the isotonic calibration is fitted to. The model returned is that of all folds. Without labels the score is 0.5 throughout, with labels
    of one kind it is this label.
    """
    scratch = Scratch()
    moments = stats.agg(*(F.avg(s).alias(f"m_{s}") for s in STATISTICS), *(F.stddev_pop(s).alias(f"s_{s}") for s in STATISTICS)).first()
    kernel = Kernel(*(np.array([moments[f"{k}_{s}"] or 0.0 for s in STATISTICS]) for k in "ms"), size=size)
    rows = scratch(_learned(stats, labels, use, id_col, label, folds))
    square, right, n = _normal_equations(rows, kernel, folds)
    positive = float(right[:, -1].sum())
    if not n.sum() or positive in (0.0, float(n.sum())):
        scratch.less(stats.sparkSession)
        return Scorer(kernel, None, (np.zeros(1), np.array([positive / n.sum() if n.sum() else 0.5])))
    rest = [(square.sum(0) - square[f], right.sum(0) - right[f], n.sum() - n[f]) for f in range(folds)]
    models = np.array([[_solved(*sums, ridge) if sums[2] else np.zeros(size + 1) for sums in rest] for ridge in ridges])

    def score(it: Iterator[pd.DataFrame]):
        for pdf in it:
            x, y, fold = kernel(pdf[list(STATISTICS)].to_numpy(float)), pdf["y"].to_numpy(float), pdf["fold"].to_numpy()
            for k, of in enumerate(models):
                raw = np.einsum("ij,ij->i", x, of[fold])
                step = np.round((_clipped(raw) + 0.5) * (_STEPS / 2)).astype(np.int64)
                yield pd.DataFrame({"k": k, "step": step, "y": y, "miss": (raw - y) ** 2})

    counts = rows.mapInPandas(score, "k int, step long, y double, miss double").groupBy("k", "step").agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum("miss").alias("miss"))
    found = counts.toPandas().sort_values(["k", "step"])  # at most _STEPS + 1 rows for each ridge
    best = int(found.groupby("k")["miss"].sum().idxmin())
    own = found[found["k"] == best]
    knots = isotonic(own["step"].to_numpy() / (_STEPS / 2) - 0.5, own["n"].to_numpy(float), own["y"].to_numpy(float))
    scratch.less(stats.sparkSession)
    return Scorer(kernel, _solved(square.sum(0), right.sum(0), n.sum(), ridges[best]), knots, ridges[best])


def quality_scores(docs: DataFrame, labels: DataFrame, use: Column | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold) of each row, and the columns carried.

    The text is measured whole (STATISTICS), once, into a table; a model is learned from the rows that have a label
    and for which use holds, by train_quality(); then every row is scored. A Gaussian kernel over the statistics is approximated by random Fourier
    features. Null and empty texts have statistics of zero, and the score that the model gives those. Very long texts are measured
    whole. Rows of null id are scored, but never learned from; repeated rows are scored like others. An empty table gives no
    rows; labels of no document and null labels are left out. Other columns are not read.
    """
    scratch = Scratch()
    stats = scratch(measured(docs, id_col, text_col, carry))
    scorer = train_quality(stats, labels, use, id_col=id_col, label=label)

    def score(it: Iterator[pd.DataFrame]):
        for pdf in it:
            scores = scorer(pdf[list(STATISTICS)].to_numpy(float))
            yield pdf.drop(columns=list(STATISTICS)).assign(score=scores, predicted=(scores >= threshold).astype(np.int32))

    kept = [c for c in stats.columns if c not in STATISTICS]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.select(*kept).schema)
    return X.handed(scratch.done(stats.mapInPandas(score, f"{kinds}, score double, predicted int")), carry)
