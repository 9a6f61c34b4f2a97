"""Documents drawn by how much their n-grams look like those of a target, by hashed n-gram counts."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .components import Scratch
from .text import strings, tidy

#: Bytes of text that are in work at once, but for a longer text.
PIECE = 4 << 20
#: Words of more bytes than this are advanced one by one.
_LONG = 48
_BEGIN = np.uint32(0xFFFFFFFF)


def _letters() -> np.ndarray:
    """What each byte counts as: itself, a capital as its small letter, or 0, which ends a word."""
    out = np.zeros(256, np.uint8)
    for a, b in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
        out[a:b] = np.arange(a, b)
    out[0x41:0x5B] = np.arange(0x61, 0x7B)
    return out


def _steps() -> np.ndarray:
    """What a byte makes of a checksum (the reflected polynomial of crc32)."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


_LETTER, _STEP = _letters(), _steps()


class Words:
    """The words of texts in a row: the letters of all texts, where each word begins and ends, and of which text it is."""

    def __init__(self, texts: pa.Array):
        n = len(texts)
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        self.letters, at = _LETTER[raw], at - at[0]
        # a byte more on either side, and one between texts: a word begins where the class rises, and ends where it falls
        gaps = np.unique(at[1:-1])
        inside = np.insert(self.letters != 0, gaps[(gaps > 0) & (gaps < len(raw))], False) if n > 1 else self.letters != 0
        turns = np.diff(np.r_[False, inside, False].astype(np.int8))
        between = gaps[(gaps > 0) & (gaps < len(raw))] if n > 1 else np.zeros(0, np.int64)
        less = lambda places: places - np.searchsorted(between + np.arange(len(between)), places, side="left")
        self.begins, self.ends = less(np.flatnonzero(turns == 1)), less(np.flatnonzero(turns == -1))
        self.text = np.searchsorted(at, self.begins, side="right") - 1
        self.n_texts = n
        self.lengths = self.ends - self.begins
        self.order = np.argsort(-self.lengths, kind="stable")

    def advanced(self, state: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Checksums of these words (in order of falling length), each begun at a state, all of them a byte at a time."""
        at, left = self.begins[of], self.lengths[of]
        long_ = int(np.searchsorted(-left, -_LONG, side="left"))  # words of more than _LONG bytes
        for k in range(long_):
            begin = at[k]
            state[k] = zlib.crc32(self.letters[begin : begin + left[k]].tobytes(), int(state[k] ^ _BEGIN)) ^ int(_BEGIN)
        state, at, left = state.copy(), at[long_:], left[long_:]
        some = state[long_:]
        live = len(left) - np.searchsorted(left[::-1], np.arange(int(left[0]) if len(left) else 0), side="right")  # how many have more than so many bytes
        for k, n in enumerate(live.tolist()):
            now = some[:n]
            some[:n] = _STEP[(now ^ self.letters[at[:n] + k]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
        return state

    def grams(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1 to n words: the last word of each run of so many in one text, and the run's crc32, words joined by a space."""
        state, of = np.full(len(self.begins), _BEGIN), self.order
        for m in range(1, n + 1):
            if m > 1:
                of = of[of >= m - 1]
                of = of[self.text[of] == self.text[of - m + 1]]
                before = state[of - 1]
                begun = _STEP[(before ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (before >> np.uint32(8))
            else:
                begun = state[of]
            state[of] = self.advanced(begun, of)
            yield of, state[of] ^ _BEGIN


def _pieces(it: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The batches cut, without copying, into such of about PIECE bytes of text, and their texts."""
    for batch in it:
        texts = strings(batch.column(place))
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        part = (at[:-1] - at[0]) // PIECE
        edge = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        for s, e in zip(edge, edge[1:], strict=False):
            if e > s:
                yield batch.slice(s, e - s), texts.slice(s, e - s)


def bucket_counts(texts: DataFrame, text_col: str = "text", n: int = 3, buckets: int = 10_000) -> np.ndarray:
    """How many features of all texts fall into each bucket. Summed in the tasks, then by bucket."""

    def count(it: Iterator[pa.RecordBatch]):
        total = np.zeros(buckets, np.int64)
        for _, own in _pieces(it, 0):
            for _, crc in Words(own).grams(n):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        tidy()
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    rows = texts.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():  # at most one row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, floor(1000 ln) of its share in the target over its share in the source, each with one count more."""
    size, s, t = float(len(source)), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log(((b + 1.0) * (s + size)) / ((a + 1.0) * (t + size)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, n: int = 3, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns carried, n_words, n_features and weight, the sum of the gains of a document's features."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), *X.carried(carry))
    numbers = ["n_words", "n_features", "weight"]

    def weigh(it: Iterator[pa.RecordBatch]):
        for batch, own in _pieces(it, 0):
            words = Words(own)
            size, features, weight = np.bincount(words.text, minlength=words.n_texts), np.zeros(words.n_texts, np.int64), np.zeros(words.n_texts, np.int64)
            for of, crc in words.grams(n):
                by_word = np.zeros(len(words.begins) + 1, np.int64)
                by_word[of + 1] = gain[crc % np.uint32(len(gain))]
                first = np.searchsorted(words.text, np.arange(words.n_texts + 1))
                sums = np.cumsum(by_word)
                weight += sums[first[1:]] - sums[first[:-1]]
                features += np.bincount(words.text[of], minlength=words.n_texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(x, pa.int64()) for x in (size, features, weight))], [*batch.schema.names[1:], *numbers])
        tidy()

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}{X.kinds(rows)}, " + ", ".join(f"{c} long" for c in numbers)
    return rows.mapInArrow(weigh, schema)


def noisy(weight: Column, doc_id: Column, seed: int) -> Column:
    """The weight and a Gumbel noise in thousandths, from the leading 32 bits of sha256 of "seed:id"."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def importance_resampling(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), least_words: int = 20, n: int = 3, buckets: int = 10_000, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Draws num / den of the documents of at least least_words words, without repetition, as if by importance weights
    (the Gumbel top-k of their log-weights): those that look most like the target, with noise.

    Words are runs of digits, letters and bytes above 0x7F, A-Z lowered; features are all runs of 1 to n words, hashed by crc32 into
    buckets. The bytes of a batch of texts are classified by a table, words are where the class rises and falls, and the checksums of all
    runs advance together, a byte at a time. Both counts are of all rows.

    One row per input row: doc_id, the columns carried, n_words, n_features, weight, score and rank (1, 2, ... by falling score, ties to the smaller
    id; null if not drawn). Null and empty texts have no features and weight 0, and are too short to be drawn; very long
    texts are taken whole. Rows of null id are weighed like others, with the noise of an empty id, and come after their ties; repeated
    rows count and are drawn each by itself. Without a target every gain is that of an empty one; an empty table gives no rows. Other
    columns are not read. Rows are ranked in ranges of scores, so no task holds more than a range.
    """
    spark, scratch = docs.sparkSession, Scratch()
    gain = gains(bucket_counts(docs, text_col, n, buckets), bucket_counts(target, target_col, n, buckets))
    rows = scratch(weighed(docs, gain, n, id_col, text_col, carry).withColumn("score", noisy(F.col("weight"), F.col("doc_id"), seed)))
    order = [F.desc(F.col("n_words") >= least_words), F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"), F.desc("weight")]
    placed = scratch(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))  # range, then place in it
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.when(F.col("n_words") >= least_words, 1)).alias("n")).orderBy("part").collect()  # a row for each range
    before, offsets = 0, []
    for r in sizes:
        offsets.append((r["part"], before))
        before += r["n"]
    drawn = share[0] * before // share[1]
    starts = spark.createDataFrame(offsets, "part long, before long")
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.when((F.col("n_words") >= least_words) & (rank <= drawn), rank))
    return X.handed(scratch.done(out.drop("part", "before", "at")), carry)
