"""Packing of tokenized documents into sequences by vector best-fit."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import stored
from .text import tidy
from .tokens import closed, encoder, slices


@dataclass(frozen=True)
class Bin:
    """What a sequence can hold: tokens, documents, and attention cost (the sum of squares of its documents' lengths)."""

    tokens: int = 2048
    docs: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001)
    rule: str = "norm"  # "norm": least weighted norm of what is left; "dot": largest weighted product of need and room


def plan(histogram: dict[int, int], bin: Bin = Bin()) -> np.ndarray:
    """Places for counts of pieces by length. Rows: length, first rank, pieces, pieces a bin, first bin, offset.

    The j-th piece of a row (by rank among those of its length) goes to bin first + j // pieces a bin, at offset
    + j % pieces a bin * length. Pieces of one length are alike in every capacity, so lengths are placed in
    descending order, and equal bins in runs: the work depends on the number of lengths, not of documents.
    """
    room = np.zeros((0, 3), np.int64)  # what is left in each run of equal bins
    runs: list[tuple[int, int]] = []  # their first bin and number
    out, bins = [], 0
    cap = np.array([bin.tokens, bin.docs, bin.attention], np.int64)
    scale = np.array(bin.weights) / cap
    for length in sorted(histogram, reverse=True):
        need = np.array([length, 1, length * length], np.int64)
        if (need > cap).any():
            raise ValueError(f"a piece of {length} tokens fits no bin")
        left, rank = histogram[length], 0
        while left:
            fits = np.flatnonzero((room >= need).all(axis=1)) if len(room) else []
            if len(fits):
                rest = (room[fits] - need) * scale
                best = fits[np.argmin((rest * rest).sum(axis=1))] if bin.rule == "norm" else fits[np.argmax((room[fits] * scale * need * scale).sum(axis=1))]
                have, (first, number) = room[best], runs[best]
            else:
                best, have, first, number = None, cap, bins, left
            each = int(min(have // need)) if bin.rule == "norm" else 1
            each = min(each, left)
            take = min(number, left // each)
            out.append((length, rank, take * each, each, first, bin.tokens - int(have[0])))
            if best is None:
                bins += take
            elif take < number:
                runs[best] = (first + take, number - take)
            else:
                room, best = np.delete(room, best, axis=0), runs.pop(best) and None
            after = have - each * need
            if (after > 0).all():
                room = np.vstack([room, after])
                runs.append((first, take))
            rank, left = rank + take * each, left - take * each
    return np.array(out, np.int64).reshape(-1, 6)


def _tokenized(docs: DataFrame, tokenizer: str, end_id: int, most: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of documents; part and nth number those of one length within the task that made them."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(it):
        own, part = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(most + 1, np.int64)
        for batch in slices(it):
            ids, at = closed(*own.encode(batch.column(1)), end_id)
            n = np.diff(at)
            count = -(-n // most)  # pieces of each document; only the first may be shorter
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            short = n[doc] - (count[doc] - 1) * most
            start = np.where(piece > 0, short + (piece - 1) * most, 0)
            length = np.where(piece > 0, most, short)
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            first = np.searchsorted(ordered, ordered)
            nth = np.empty(len(doc), np.int64)
            nth[order] = np.arange(len(doc)) - first + seen[ordered]
            seen += np.bincount(length, minlength=most + 1)
            begin = at[doc] + start
            crc = np.fromiter((zlib.crc32(ids[s:e]) for s, e in zip(begin, begin + length, strict=True)), np.int64, len(doc))
            columns = [batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), *map(pa.array, (start, length, crc)), pa.array(np.full(len(doc), part, np.int32)), pa.array(nth)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])
        tidy()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def best_fit_packing(docs: DataFrame, tokenizer: str, end_id: int = 0, bin: Bin = Bin(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs whole documents, each followed by end_id, into as few sequences as vector best-fit finds.

    A document longer than a sequence is cut into full pieces, of which the first may be shorter. Pieces are
    counted by length (at most bin.tokens counts reach the driver), the counts are packed by plan(), and each
    piece finds its place from its rank among those of its length. Ranks are sums over tasks of counts, so no
    length meets in one task. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and
    empty texts are one piece of end_id; null ids, ties and repeated rows are pieces like others. Very long texts are
    tokenized whole; an empty table gives no rows. Other columns are not read.
    """
    cut = stored(_tokenized(docs, tokenizer, end_id, bin.tokens, id_col, text_col))
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    rows = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, bin)
    before = counts.withColumn("base", F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).select("part", "length", "base")
    kind = cut.schema["doc_id"].dataType.simpleString()
    # by length, then by first rank
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    table = rows[:, 0] << np.int64(48) | rows[:, 1]

    def place(it):
        for pdf in it:
            rank = (pdf["base"] + pdf["nth"]).to_numpy(np.int64)
            length = pdf["length"].to_numpy(np.int64)
            row = rows[np.searchsorted(table, length << np.int64(48) | rank, side="right") - 1]
            j = rank - row[:, 1]
            yield pdf[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=row[:, 4] + j // row[:, 3], offset=row[:, 5] + j % row[:, 3] * length)

    return cut.join(before, ["part", "length"]).mapInPandas(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
