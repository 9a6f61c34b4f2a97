"""Language-model scores of documents from n-gram counts of the whole corpus."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .text import rolling, starts_within, word_hashes


def _grams(texts) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Keys of all 1-, 2- and 3-grams within documents, where documents begin, and the places at which n-grams end."""
    hashes, at = word_hashes(texts)
    keys, ends = [], []
    for n in (1, 2, 3):
        inside = np.flatnonzero(starts_within(at, n))
        keys.append(rolling(hashes, n)[inside])
        ends.append((inside + (n - 1)).astype(np.int32 if len(hashes) < 1 << 31 else np.int64))
    return np.concatenate(keys), at, ends


def stupid_backoff(docs: DataFrame, backoff: float = 0.4, min_count: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Trigram stupid backoff, counted over all documents and scored for each of them.

    A word's score is count(3-gram) / count(its first 2 words) where the 3-gram occurs at least min_count
    times, else backoff times the same for 2-grams, else backoff twice times count(word) / all words; a
    document's first words start at the lower order. Words are as written. N-grams are counted by
    64-bit hashes. Count tables are partitioned by hash: each bucket counts its n-grams over all chunks and joins
    the counts to the n-grams that every chunk exploded. Before that, chunks send the leading bits of each n-gram's
    hash only, six more than it takes to number all n-grams of the corpus: what no other chunk has by these bits
    no other chunk has at all, so the chunk's own count is the count, and the whole hash stays where it is.

    One row per input row: doc_id, n_words, log_score (sum of natural logarithms; 0 without words),
    mean_log_score (null without words), n_trigram, n_bigram, n_unigram (words scored at each order).
    Null and empty texts have no words, an empty table no rows; very long texts are counted and scored whole, in a
    chunk of their own size. Repeated rows and rows of null id count and are scored like others. Other columns are not read.
    """
    total = X.measure(docs, text_col, words=F.regexp_count(F.col(text_col), F.lit("[^\\x20\\x09-\\x0D]+")))
    bits = X.buckets(total["bytes"] // 3)
    short = min(64, max(bits + 8, int(3 * total["words"] + 1).bit_length() + 6))
    parts = X.chunked(docs, total["bytes"], id_col, text_col, chunk_bytes=2 * X.CHUNK_BYTES)  # larger: n-grams that recur within one are sent once
    log_all, log_back = float(np.log(max(total["words"], 1))), float(np.log(backoff))

    def leading(keys):
        return keys >> np.uint64(64 - short)

    def probe(pdf):
        keys = X.distinct(leading(_grams(pdf["text"])[0]))
        return keys, np.zeros(len(keys), np.uint64)

    def met(number, first):
        """1 for keys that several chunks sent."""
        return (np.diff(np.r_[first, len(number)]) > 1).astype(np.uint64)

    def shared(keys, flags):
        """Of distinct sorted keys, which may be in other chunks too."""
        ahead = leading(keys)
        return flags[np.cumsum(np.r_[True, ahead[1:] != ahead[:-1]]) - 1] > 0 if len(keys) else np.zeros(0, bool)

    def count(pdf, flags):
        keys, own = X.tally(_grams(pdf["text"])[0])
        out = shared(keys, flags)
        return keys[out], own[out]

    def score(pdf, flags, counts):
        keys, at, ends = _grams(pdf["text"])
        size, done = int(at[-1]), 0
        order = np.argsort(keys).astype(ends[0].dtype if 3 * size < 1 << 31 else np.int64)
        keys = keys[order]
        new = np.r_[True, keys[1:] != keys[:-1]][: len(keys)]
        own = np.diff(np.flatnonzero(np.r_[new, True])).astype(np.uint64)  # occurrences of each distinct n-gram in the chunk
        own[shared(keys[new], flags)] = counts
        del keys
        found = np.empty(len(order), np.uint64)
        found[order] = own[np.cumsum(new) - 1]
        del order, own, new
        by_order = []
        for places in ends:
            full = np.zeros(size, np.uint64)
            full[places] = found[done : done + len(places)]
            done += len(places)
            by_order.append(full)
        del found, ends
        one, two, three = by_order
        one = one.astype(float)
        before_one, before_two = np.r_[1.0, one[:-1]], np.maximum(np.r_[np.uint64(1), two[:-1]], 1).astype(float)
        place = np.arange(size) - np.repeat(at[:-1], np.diff(at))
        order = np.where(three >= min_count, 3, np.where(two >= min_count, 2, 1))
        logs = np.select(
            [order == 3, order == 2],
            [np.log(np.maximum(three, 1) / before_two), np.log(np.maximum(two, 1) / before_one)],
            np.log(one) - log_all,
        )
        logs += log_back * (np.minimum(place + 1, 3) - order)
        lengths = np.diff(at)
        scores = [float(logs[s:e].sum()) for s, e in zip(at, at[1:], strict=False)]
        by = {k: np.diff(np.r_[0, np.cumsum(order == k)][at]) for k in (3, 2, 1)}
        mean = [s / n if n else None for s, n in zip(scores, lengths, strict=True)]
        return pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": lengths, "log_score": scores, "mean_log_score": pd.Series(mean, dtype=object), "n_trigram": by[3], "n_bigram": by[2], "n_unigram": by[1]})

    flagged = X.answers(X.send(parts, probe, bits, width=short), met, 0, bits, in_order=True, width=short)
    counted = X.answers(X.send(parts, count, bits, flagged, lambda a: (X.numbers(a),)), None, 1, bits, in_order=True)
    kind = parts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, log_score double, mean_log_score double, n_trigram long, n_bigram long, n_unigram long"
    return X.finish(parts, X.both(flagged, counted), score, schema, bits, lambda a: map(X.numbers, X.each(a)))
