"""Documents that hold benchmark items, copied or edited."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .text import rolling, starts_within, tidy, word_hashes

#: Bytes of items that go to every task at once; more are taken in parts, each against all documents.
PART_BYTES = 16 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
_BAND = 8


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman over words: the best local score and the place in text after its last word (the first such)."""
    step = -GAP * np.arange(len(text) + 1)
    above, best, end = np.zeros(len(text) + 1, np.int64), 0, 0
    for word in item:
        row = np.zeros(len(text) + 1, np.int64)
        row[1:] = above[:-1] + np.where(text == word, MATCH, MISMATCH)
        np.maximum(row, above + GAP, out=row)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + step) - step  # gaps in the item
        if row.max() > best:
            best, end = int(row.max()), int(row.argmax())
        above = row
    return best, end


class _Items:
    """A part of the benchmark as arrays, which go to the tasks: words and seeds, all n-grams of words (a shorter item is one)."""

    def __init__(self, rows: list, n: int):
        self.ids = [r["item_id"] for r in rows]
        self.words, self.at = word_hashes([r["text"] for r in rows], lower=True)
        lengths = np.diff(self.at)
        sizes = np.minimum(n, lengths)
        self.lengths = sorted(set(sizes[sizes > 0].tolist()))
        seeds, item, place = [], [], []
        for m in self.lengths:
            own = sizes == m
            begins = np.flatnonzero(starts_within(self.at, m)) if len(self.words) >= m else np.zeros(0, int)
            of = np.searchsorted(self.at, begins, side="right") - 1
            begins, of = begins[own[of]], of[own[of]]
            seeds.append(rolling(self.words, m)[begins])
            item.append(of)
            place.append(begins - self.at[of])
        seeds, item, place = (np.concatenate([np.zeros(0, kind), *parts]) for kind, parts in ((np.uint64, seeds), (np.int64, item), (np.int64, place)))
        order = np.argsort(seeds, kind="stable")
        seeds = seeds[order]
        first = np.flatnonzero(np.r_[True, seeds[1:] != seeds[:-1]]) if len(seeds) else np.zeros(0, int)
        #: Distinct seeds in order, and where their items and places in them are.
        self.known, self.first = seeds[first], np.r_[first, len(seeds)]
        self.item, self.place = item[order].astype(np.int32), place[order].astype(np.int32)
        n_seeds = np.bincount(item, minlength=len(lengths))
        self.least = np.where(n_seeds <= max(self.lengths, default=0) + 1, 1, 2)  # one edit can leave a single seed of so few

    def item_words(self, k: int) -> np.ndarray:
        return self.words[self.at[k] : self.at[k + 1]]


def _hits(hashes: np.ndarray, at: np.ndarray, lengths: list[int], known: np.ndarray):
    """Places at which seeds begin, and the seeds, ordered by place."""
    places, seeds = [], []
    for m in lengths:
        keys = rolling(hashes, m)
        here = np.flatnonzero(X.look_up(keys, known) & starts_within(at, m)) if len(keys) else np.zeros(0, int)
        places.append(here)
        seeds.append(keys[here])
    places, seeds = np.concatenate([np.zeros(0, int), *places]), np.concatenate([np.zeros(0, np.uint64), *seeds])
    order = np.argsort(places, kind="stable")
    return places[order], seeds[order]


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 3, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs of documents and benchmark items that align, one row each: doc_id, item_id, score, start, end.

    Seeds are word n-grams of items, A-Z lowered; all are kept, however frequent. Whole documents are joined to
    items by seeds: two on nearby diagonals (one, for items of at most n + 1 seeds) are a candidate, which
    Smith-Waterman aligns (match 2, others -1) around there. An edited copy that leaves no two n-grams of an
    item intact (every third word replaced, at n = 3, or the middle word of an item of five) is no candidate, even if it would align. score is the best score as a share of the item's own; start and end are words of the
    document that the alignment spans. Rows of threshold or more are returned.

    Items go to the tasks in parts of at most about PART_BYTES of text, each part against all documents. Null
    and empty texts on either side align with nothing, and an empty table gives no rows; rows of null id and repeated
    documents and items have rows each. Very long texts are searched whole. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    items = benchmark.select("item_id", "text").where("text IS NOT NULL AND length(text) > 0")
    parts = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / PART_BYTES))
    kinds = rows.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    out = None
    for p in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p)
        found = _part(rows, _Items(own.orderBy("item_id", "text").collect(), n), threshold, *kinds)
        out = found if out is None else out.unionByName(found)
    return out


def _part(rows: DataFrame, part: _Items, threshold: float, doc_kind: str, item_kind: str) -> DataFrame:
    def match(it):
        for pdf in it:
            found = []
            for few in X.pieces([pdf]):
                hashes, at = word_hashes(few["text"], lower=True)
                places, seeds = _hits(hashes, at, part.lengths, part.known)
                text_of = np.searchsorted(at, places, side="right") - 1
                which = np.searchsorted(part.known, seeds)
                diagonals = defaultdict(list)
                for d, place, s, e in zip(text_of.tolist(), places.tolist(), part.first[which].tolist(), part.first[which + 1].tolist(), strict=True):
                    for k, where in zip(part.item[s:e].tolist(), part.place[s:e].tolist(), strict=True):
                        diagonals[d, k].append(place - where)
                for (d, k), all_of in diagonals.items():
                    words = part.item_words(k)
                    best = _best(sorted(all_of), part.least[k], words, hashes[at[d] : at[d + 1]], int(at[d]))
                    if best and best[0] >= threshold * MATCH * len(words):
                        found.append((few["doc_id"].iloc[d], part.ids[k], best[0] / (MATCH * len(words)), best[1], best[2]))
            yield pd.DataFrame(found, columns=["doc_id", "item_id", "score", "start", "end"])
        tidy()

    return rows.mapInPandas(match, f"doc_id {doc_kind}, item_id {item_kind}, score double, start long, end long")


def _best(diagonals: list[int], least: int, item: np.ndarray, text: np.ndarray, begin: int) -> tuple[int, int, int] | None:
    """The best alignment near any group of diagonals close to each other that has enough seeds."""
    best, pad, group = None, len(item) // 2 + _BAND, []
    for diagonal in [*diagonals, None]:
        if group and (diagonal is None or diagonal - group[-1] > _BAND):
            if len(group) >= least:
                lo = max(0, group[0] - begin - pad)
                hi = min(len(text), group[-1] - begin + len(item) + pad)
                score, end = align(item, text[lo:hi])
                if best is None or score > best[0]:
                    back, length = align(item[::-1], text[lo : lo + end][::-1])
                    best = (score, lo + end - length, lo + end)
            group = []
        group.append(diagonal)
    return best
