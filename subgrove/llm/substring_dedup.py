"""Removal of word runs that occur more than once in a corpus."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import exchange as X
from .text import covered, rolling, starts_within, word_hashes, words

_MANY, _ANCHOR = np.uint64(1), np.uint64(1 << 32)
#: Bits of a block's hash that are sent. A chance clash is one more hit whose windows are looked up in vain.
_SENT = ~np.uint64(0xFFFF)


def substring_dedup(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes every word in a window of so many words whose sequence also starts elsewhere.

    Reference blocks are the non-overlapping runs of (window + 1) // 2 words of each document; every window
    holds one whole block. All rolling runs of that length probe the block index, by hash. Around each hit the
    windows that hold it are looked up in turn, and consecutive repeated windows join into maximal repeats.

    One row per input row: doc_id, n_words, n_removed, kept_text (kept words joined by one space), spans (word
    offsets of the maximal repeats, end exclusive). Null and empty texts have no words; null ids are kept as
    they are; repeated rows are copies of each other; very long texts are taken whole; an empty table gives no rows.
    Windows are compared by 64-bit hashes. Other columns are not read.
    """
    block = (window + 1) // 2
    size = X.measure(docs, text_col)["bytes"]
    bits = X.buckets(size // 6)
    parts = X.chunked(docs, size, id_col, text_col)

    def probes(pdf: pd.DataFrame):
        hashes, at = word_hashes(pdf["text"])
        inside = np.flatnonzero(starts_within(at, block))
        place = inside - at[np.searchsorted(at, inside, side="right") - 1]
        keys, number = X.tally(rolling(hashes, block)[inside] & _SENT, np.where(place % block == 0, _MANY + _ANCHOR, _MANY))
        return keys, np.minimum(number & np.uint64(0xFFFFFFFF), np.uint64(2)) | (number >> np.uint64(32) != 0).astype(np.uint64) << np.uint64(2)

    def anchored(number: np.ndarray, first: np.ndarray) -> np.ndarray:
        count = np.add.reduceat(number & np.uint64(3), first)
        return ((count >= 2) & (np.bitwise_or.reduceat(number, first) >= 4)).astype(np.uint64)

    def windows(pdf: pd.DataFrame, known: np.ndarray, _):
        hashes, at = word_hashes(pdf["text"])
        hits = np.flatnonzero(X.look_up(rolling(hashes, block) & _SENT, known) & starts_within(at, block)) if len(hashes) >= block else np.zeros(0, int)
        if len(hashes) < window:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        near = covered(np.maximum(hits - (window - block), 0), window - block + 1, len(hashes))[: len(hashes) - window + 1]
        keys, number = X.tally(rolling(hashes, window)[near & starts_within(at, window)])
        return keys, np.minimum(number, np.uint64(2))

    def cut(pdf: pd.DataFrame, known: np.ndarray, _) -> pd.DataFrame:
        hashes, at = word_hashes(pdf["text"])
        again = X.look_up(rolling(hashes, window), known) & starts_within(at, window) if len(hashes) >= window else np.zeros(0, bool)
        gone = covered(np.flatnonzero(again), window, len(hashes))
        rows = []
        for doc, text, s, e in zip(pdf["doc_id"], pdf["text"], at, at[1:], strict=False):
            out, own = gone[s:e], words(text)
            edge = np.flatnonzero(np.diff(np.r_[False, out, False]))
            kept = b" ".join(w for w, x in zip(own, out.tolist(), strict=True) if not x) if len(edge) else b" ".join(own)
            rows.append((doc, e - s, int(out.sum()), kept.decode(), [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]))
        return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_text", "spans"])

    live = X.answers(X.send(parts, probes, bits), anchored, 1, bits)
    twice = X.answers(X.send(parts, windows, bits, live), None, 2, bits)
    kind = parts.schema["doc_id"].dataType.simpleString()
    return X.finish(parts, twice, cut, f"doc_id {kind}, n_words long, n_removed long, kept_text string, spans array<struct<start:int,end:int>>", bits)
