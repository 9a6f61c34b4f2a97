"""Removal of lines whose template recurs across documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .components import stored, sweep
from .ngram_jaccard import ngram_jaccard
from .text import hashed_in_place, mix, raw_bytes, strings, word_places

_U = np.uint64
_FIELD, _STEP, _COUNT = _U(0xD6E8FEB86659FD93), _U(0x9E3779B97F4A7C15), _U(0xA0761D6478BD642F)
_ALWAYS = np.iinfo(np.int64).max


class Lines:
    """The lines of a chunk's texts in the tree: a line's node is its number of tokens and its first depth tokens."""

    def __init__(self, texts, depth: int):
        raw, at = raw_bytes(strings(texts))
        ends = np.flatnonzero(raw == 10)
        self.at = np.searchsorted(ends, at) + np.arange(len(at))  # lines of each text
        first, end = word_places(raw, at)
        self.tokens, digit = hashed_in_place(raw, first, end)
        self.tokens[digit] = _FIELD
        self.begin = np.r_[np.searchsorted(first, np.sort(np.r_[at[:-1], ends + 1])), len(first)]
        del raw, ends, first, end, digit
        self.counts = np.diff(self.begin)
        self.line = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)  # of each token
        place = np.arange(len(self.tokens), dtype=np.int32) - self.begin[:-1].astype(np.int32)[self.line]
        self.leading = place < depth
        self.terms = mix(self.tokens ^ mix(np.arange(int(self.counts.max(initial=0)), dtype=np.uint64) * _STEP + _COUNT)[place])
        self.node = self._sums(self.leading)

    def _sums(self, taken: np.ndarray) -> np.ndarray:
        """Of each line, a hash of its number of tokens and of the tokens taken, at their places."""
        sums = np.zeros(len(self.tokens) + 1, np.uint64)
        np.cumsum(np.where(taken, self.terms, _U(0)), out=sums[1:])
        return mix(sums[self.begin[1:]] - sums[self.begin[:-1]] + self.counts.astype(np.uint64) * _COUNT)

    def below(self) -> np.ndarray:
        """Of each token after the leading ones, its key: what it is and where, below which node."""
        own = np.flatnonzero(~self.leading)
        return mix(self.node[self.line[own]] + self.terms[own])

    def templates(self, often: np.ndarray, least: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
        """The lines that have a template, and its key. often: in how many lines each token of below() is."""
        seen = np.full(len(self.tokens), _ALWAYS)
        seen[~self.leading] = np.where(often >= least, often, 0)
        needed = np.maximum(np.ceil(self.counts * similarity - 1e-9).astype(np.int64), 1)
        filled = np.bincount(self.line[seen > 0], minlength=len(self.counts)) >= needed
        worded = np.bincount(self.line[self.tokens != _FIELD], minlength=len(self.counts)) > 0
        lines = np.flatnonzero(filled & worded)
        if not len(lines):
            return lines, np.zeros(0, np.uint64)
        some = np.flatnonzero((filled & worded)[self.line])
        first = np.r_[0, np.cumsum(self.counts[lines])[:-1]]
        level = np.zeros(len(self.counts), np.int64)
        level[lines] = _largest(seen[some], self.line[some], first + needed[lines] - 1)
        kept = self.leading.copy()
        kept[some] |= (seen[some] > 0) & (2 * seen[some] >= level[self.line[some]])
        return lines, self._sums(kept)[lines]


def _largest(seen: np.ndarray, line: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The counts at these places once those of each line (lines in order) are ordered from the largest."""
    if len(line) and line[-1] >= 1 << 24:
        return seen[np.lexsort((-seen, line))][at]
    top = _U((1 << 40) - 1)  # line and count in one number, which sorts much faster
    packed = (line.astype(np.uint64) << _U(40)) | (top - np.minimum(seen.astype(np.uint64), top))
    packed.sort()
    found = top - (packed[at] & top)
    return np.where(found == top, _ALWAYS, found.astype(np.int64))


def _by_document(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how many documents have them."""
    order = np.lexsort((doc, keys))
    keys, doc = keys[order], doc[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    return X.tally(keys[new])


def line_templates(docs: DataFrame, depth: int = 2, min_docs: int = 8, similarity: float = 0.75, copies: tuple[int, int] | None = None, max_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Drops every line whose template at least min_docs documents have.

    The tree has a fixed depth: a line (between line ends) goes down by its number of tokens, then by its first depth
    tokens, and arrives at a node. Tokens with a digit are one and the same token, a field. At a node, each further
    token is counted at its place over all lines of the corpus. The level of a line is the largest count that at
    least similarity of its tokens reach, the leading ones included; the tokens whose count is half of the level or
    more stay in its template, and all others are fields, any number of them. Lines of which too few tokens are in
    min_docs lines at their places have no template, and can't recur; nor have lines of fields only. Documents are
    then counted by template. Counts are sums, so the result does not depend on the order of lines or documents, and
    a node may hold any number of lines. Templates and tokens are compared by 64-bit hashes.

    copies (num, den), for corpora from which near duplicates are still to be removed: documents of whose tokens more than max_share
    would go are joined by Jaccard similarity, and a class of linked ones counts as one document for the lines of its members: these
    lose lines that recur beyond their own copies only. By default every document counts.

    One row per input row: doc_id, text (kept lines), n_lines, n_recurring (lines of recurring templates), n_dropped.
    Null texts stay null with 0 lines, empty texts have one line; an empty table gives no rows. Very long texts and
    lines are taken whole. Rows of null id and repeated rows count as documents. Columns named in carry are returned
    too; others are not read.
    """
    size = X.measure(docs, text_col)["bytes"]
    bits = X.buckets(size // 6)
    parts = X.chunked(docs, size, id_col, text_col, carry, 2 * X.CHUNK_BYTES)

    def places(pdf):
        return X.tally(Lines(pdf["text"], depth).below())

    def named(lines, known, count):
        return lines.templates(X.look_up(lines.below(), known, count), min_docs, similarity)

    def emit(pdf, known, count):
        lines = Lines(pdf["text"], depth)
        own, keys = named(lines, known, count)
        doc = np.searchsorted(lines.at, own, side="right") - 1
        return _by_document(keys, doc)

    def cut(pdf, tokens_seen, seen):
        lines = Lines(pdf["text"], depth)
        own, keys = named(lines, *X.read(tokens_seen, bits))
        recurring = np.zeros(len(lines.counts), bool)
        if copies:
            docs_of, key_of = np.zeros(len(lines.counts), np.int64), np.zeros(len(lines.counts), np.int64)
            docs_of[own], key_of[own] = X.look_up(keys, *X.read(seen, bits)).astype(np.int64), keys.view(np.int64)
            recurring = docs_of > 0
        else:
            recurring[own[X.look_up(keys, X.read(seen, bits)[0])]] = True
        rows = []
        chunk = int(pdf["chunk"].iloc[0]) << 32
        for k, (doc, text, s, e) in enumerate(zip(pdf["doc_id"], pdf["text"], lines.at, lines.at[1:], strict=False)):
            again, count = recurring[s:e], lines.counts[s:e]
            n = int(again.sum())
            less = "\n".join(x for x, r in zip(text.split("\n"), again.tolist(), strict=True) if not r) if n else text
            open_ = n and count[again].sum() > max_share * count.sum() and copies
            marks = [{"line": int(i), "key": int(key_of[s + i]), "n": int(docs_of[s + i])} for i in np.flatnonzero(again)] if open_ else None
            rows.append((doc, less, e - s if text is not None else 0, n, n, text if open_ else None, marks, chunk + k))
        out = pd.DataFrame(rows, columns=["doc_id", "text", "n_lines", "n_recurring", "n_dropped", "whole", "marks", "row"])
        return out.assign(**{c: pdf[c].array for c in pdf if c.startswith("carry_")})

    usual = X.answers(X.send(parts, places, bits), None, min_docs, bits)
    often = X.answers(X.send(parts, emit, bits, usual), None, min_docs, bits)
    kind = parts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text string, n_lines long, n_recurring long, n_dropped long, whole string, marks array<struct<line:int,key:long,n:long>>, row long{X.kinds(parts)}"
    rows = X.finish(parts, X.both(usual, often), cut, schema, bits, X.each)
    if not copies:
        return X.handed(rows.drop("whole", "marks", "row"), carry)
    rows = stored(rows)
    del usual, often, parts
    sweep(docs.sparkSession)
    open_ = rows.where("whole IS NOT NULL")
    linked = ngram_jaccard(open_.select("row", "whole"), similarity=copies, id_col="row", text_col="whole").select(F.col("doc_id").alias("row"), "component_id")
    marks = open_.select("row", F.explode("marks").alias("m")).select("row", "m.*").join(linked, "row")
    inside = marks.select("component_id", "key", "row").distinct().groupBy("component_id", "key").agg(F.count("*").alias("inside"))
    beyond = marks.join(inside, ["component_id", "key"]).where(F.col("n") - F.col("inside") + 1 >= min_docs)
    lost = beyond.groupBy("row").agg(F.collect_list("line").alias("lost"))
    decided = open_.drop("text", "n_dropped").join(lost, "row", "left").withColumn("lost", F.coalesce("lost", F.array().cast("array<int>")))
    left = F.filter(F.split("whole", "\n", -1), lambda x, i: ~F.array_contains("lost", i))
    decided = decided.withColumns({"text": F.array_join(left, "\n"), "n_dropped": F.size("lost").cast("long")}).drop("lost")
    return X.handed(rows.where("whole IS NULL").unionByName(decided).drop("whole", "marks", "row"), carry)
