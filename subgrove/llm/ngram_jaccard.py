"""Exact Jaccard self-join of documents on word shingles, as classes of linked documents."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import exchange as X
from .components import Scratch, components, sweep
from .text import mix, rolling, starts_within, tidy, word_hashes

_U = np.uint64
_SEG, _VAL, _DEL = _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB), _U(0x8EBC6AF09C88C6E3)
_NEVER = float(1 << 40)
#: One segment of so many is also indexed less each one of its elements.
DELETABLE = 4
#: Bits of a set's number left for sets whose names begin alike.
_CLASH_BITS = 4
#: Bits of a shingle's hash by which it is counted. A chance clash only makes a shingle look shared, which costs work and changes nothing.
_COUNTED = ~_U(0xFFFF)


def shingles(hashes: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, in order, and where each text's begin. A text of 1 to n - 1 words is one shingle."""
    lengths = np.diff(at)
    inside = np.flatnonzero(starts_within(at, n))
    keys, doc = rolling(hashes, n)[inside], np.searchsorted(at, inside, side="right") - 1
    few = np.flatnonzero((lengths > 0) & (lengths < n))
    whole = [mix(np.array([rolling(hashes[at[d] : at[d + 1]], int(lengths[d]))[0]], _U) + _U(lengths[d]))[0] for d in few]
    keys, doc = np.r_[keys, np.array(whole, _U)], np.r_[doc, few]
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    keys, doc = keys[new], doc[new]
    return keys, np.searchsorted(doc, np.arange(len(lengths) + 1))


class Bands:
    """Sizes in bands [low, high]; a set of at most high elements that is in a band has segments(band) segments."""

    def __init__(self, num: int, den: int, ratio: float = 1.15):
        self.num, self.den, self.lows = num, den, [1]
        self.ratio = ratio

    def _grow(self, size: int) -> None:
        while self.lows[-1] <= size:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * self.ratio) + 1))

    def of(self, size: int) -> int:
        self._grow(size)
        return bisect.bisect_right(self.lows, size) - 1

    def high(self, band: int) -> int:
        while len(self.lows) <= band + 1:
            self._grow(self.lows[-1])
        return self.lows[band + 1] - 1

    def apart(self, a: int, b: int) -> int:
        """Elements in which sets of these sizes may differ and still be linked."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def probed(self, size: int) -> range:
        """Bands of the sets of at most this size that may be linked with one of this size."""
        return range(self.of(max(1, -(-size * self.num // self.den))), self.of(size) + 1)

    def segments(self, band: int) -> int:
        """One more a segment than the largest prober can differ in, and a tenth, so that empty and frequent ones can be left out."""
        high = self.high(band)
        most = self.apart(high * self.den // self.num, high)
        return (11 * (most + 1) + 9) // 10


def _times(band: int) -> np.uint64:
    return _U(int(_SEG) * band & 0xFFFFFFFFFFFFFFFF)


def _cut(values: np.ndarray, often: np.ndarray, band: int, count: int):
    """A set's elements ordered by segment: values to be summed, how often each occurs, segment starts, sums."""
    segment = (mix(values ^ _times(band + 1)) % _U(count)).astype(np.int64)
    order = np.argsort(segment, kind="stable")
    segment, values, often = segment[order], mix(values[order] + _VAL), often[order]
    edge = np.searchsorted(segment, np.arange(count + 1))
    sums = np.r_[_U(0), np.cumsum(values, dtype=np.uint64)]
    return segment, values, often, edge, sums[edge[1:]] - sums[edge[:-1]]


def _key(band: int, segment: np.ndarray, total: np.ndarray) -> np.ndarray:
    return mix(mix(total + _times(band)) + segment.astype(np.uint64) * _VAL)


def index_keys(values: np.ndarray, often: np.ndarray, size: int, bands: Bands) -> np.ndarray:
    """Keys of a set in its own band: each whole segment, and each deletable segment less one element."""
    band = bands.of(size)
    count = bands.segments(band)
    segment, part, _, _, total = _cut(values, often, band, count)
    some = segment % DELETABLE == 0
    return np.r_[_key(band, np.arange(count), total), _key(band, segment[some], total[segment[some]] - part[some]) ^ _DEL]


def probe_keys(values: np.ndarray, often: np.ndarray, size: int, lone: int, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which a set looks for others of at most its size.

    A segment allotted 1 finds sets that have just the same elements there, one allotted 2 also those that
    have one more or one less (deletable segments only). If the allotments of a band sum to more than the
    elements in which linked sets can differ there, no linked set is missed. lone elements occur in no other
    set: they leave that much less to differ. A segment's cost is the number of index entries that can have its key, which is at most how
    often its rarest element occurs; cheapest first. The second array is each key's rank in this order: of two
    sets that can differ in k elements that others have too, the first k + 1 suffice.
    """
    found, ranks = [], []
    for band in bands.probed(size):
        need = bands.apart(size, min(bands.high(band), size)) - lone + 1
        if need <= 0:
            continue
        count = bands.segments(band)
        segment, part, seen, edge, total = _cut(values, often, band, count)
        filled = np.diff(edge)
        some = np.flatnonzero(filled)
        rare, second = np.full(count, _NEVER), np.full(count, _NEVER)
        if len(some):
            rare[some] = np.minimum.reduceat(seen, edge[some])
            first = np.zeros(len(seen), bool)
            order = np.lexsort((seen, segment))
            first[order[np.r_[True, segment[order][1:] != segment[order][:-1]]]] = True
            second[some] = np.minimum.reduceat(np.where(first, _NEVER, seen), edge[some])
        one = rare + 1
        two = np.maximum(one, rare + second + (filled - 1) * rare + filled)
        two[np.arange(count) % DELETABLE != 0] = np.inf
        costs = np.r_[one, two]
        chosen = np.argsort(costs, kind="stable")[:need]
        rank = np.full(2 * count, -1)
        rank[chosen] = np.arange(need)
        single, double = rank[:count], rank[count:]
        at = np.flatnonzero(single >= 0)
        found.append(_key(band, at, total[at]))
        ranks.append(single[at])
        at = np.flatnonzero(double >= 0)
        found.append(_key(band, at, total[at]) ^ _DEL)
        ranks.append(double[at])
        mine = double[segment] >= 0
        found.append(_key(band, segment[mine], total[segment[mine]] - part[mine]))
        ranks.append(double[segment[mine]])
    return np.concatenate([np.zeros(0, np.uint64), *found]), np.concatenate([np.zeros(0, int), *ranks])


def _sets(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """A row per document: its number of shingles and, if it can be linked with another at all, the two parts of the
    name of its set (116 bits of a hash), the shingles that other documents have too and how often they occur. The
    first part begins with the share of shingles that no other document has: the least is the most typical."""
    size = X.measure(docs, text_col)["bytes"]
    bits = X.buckets(size // 7)
    parts = X.chunked(docs, size, id_col, text_col)

    def emit(pdf):
        keys, at = shingles(*word_hashes(pdf["text"], lower=True), n)
        return X.tally(keys & _COUNTED)

    def name(pdf, known, counts):
        keys, at = shingles(*word_hashes(pdf["text"], lower=True), n)
        often = X.look_up(keys & _COUNTED, known, counts)
        rows = []
        for doc, s, e in zip(pdf["doc_id"], at, at[1:], strict=False):
            own, seen = keys[s:e], often[s:e]
            more = seen >= 2
            m = int(more.sum())
            row = [doc, e - s, None, None, None, None]
            if e > s and m * den >= (e - s) * num:  # the other set has as much of this one, at least
                name = xxhash.xxh3_128_intdigest(own.tobytes())
                row[2:] = [(e - s - m) * 100 // (e - s) << 56 | name >> 76 << _CLASH_BITS, (name & (1 << 64) - 1) - (1 << 63), own[more].tobytes(), np.minimum(seen[more], 0xFFFFFFFF).astype("<u4").tobytes()]
            rows.append(row)
        return pd.DataFrame(rows, columns=["doc_id", "n_shingles", "rep", "name", "shared", "often"]).astype({"rep": "Int64", "name": "Int64"})

    twice = X.answers(X.send(parts, emit, bits), None, 2, bits)
    kind = parts.schema["doc_id"].dataType.simpleString()
    return X.finish(parts, twice, name, f"doc_id {kind}, n_shingles long, rep long, name long, shared binary, often binary", bits)


def _classes(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """A row per distinct set. Should names of several sets begin alike, these are numbered, so that rep names one set in any case."""
    rows = scratch(sets.where("rep IS NOT NULL").groupBy("rep", "name", "n_shingles").agg(F.min("doc_id").alias("least"), F.first("shared").alias("shared"), F.first("often").alias("often")))
    if rows.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return rows.withColumn("first", F.col("rep"))
    nth = F.row_number().over(W.partitionBy("rep").orderBy("name", "n_shingles")) - 1
    rep = F.when(F.col("nth") < 1 << _CLASH_BITS, F.col("rep") + F.col("nth")).otherwise(F.raise_error(F.lit("too many sets of one name")).cast("long"))
    return scratch(rows.withColumn("nth", nth).select(rep.alias("rep"), F.col("rep").alias("first"), "name", "n_shingles", "least", "shared", "often"))


def _keys(classes: DataFrame, num: int, den: int) -> DataFrame:
    """Rows key, rep, rank: what each set is indexed by (rank -1) and looks for."""

    def make(it):
        bands = Bands(num, den)
        for pdf in X.pieces(it, 200):
            ids, keys, ranks = [], [], []
            for rep, size, shared, often in zip(pdf["rep"], pdf["n_shingles"], pdf["shared"], pdf["often"], strict=True):
                values, seen = np.frombuffer(shared, "<u8"), np.frombuffer(often, "<u4").astype(float)
                indexed = index_keys(values, seen, size, bands)
                looked, rank = probe_keys(values, seen, size, size - len(values), bands)
                keys += [indexed, looked]
                ranks += [np.full(len(indexed), -1), rank]
                ids.append(np.full(len(indexed) + len(looked), rep))
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "rep": np.concatenate(ids), "rank": np.concatenate(ranks)})
        tidy()

    return classes.select("rep", "n_shingles", "shared", "often").mapInPandas(make, "key long, rep long, rank int")


def _sketched(classes: DataFrame) -> DataFrame:
    """rep, n_shingles, own (shingles that others have too) and p0 to p3, the parities of their counts in 256 bins.

    Two sets differ in at least as many elements as bins in which their parities differ.
    """

    def make(it):
        for pdf in it:
            bins = [np.bincount((mix(np.frombuffer(x, "<u8")) >> _U(56)).astype(np.int64), minlength=256) & 1 for x in pdf["shared"]]
            parity = np.packbits(np.array(bins, np.uint8).reshape(-1, 256), axis=1).view(np.int64)
            own = [len(x) // 8 for x in pdf["shared"]]
            yield pdf[["rep", "n_shingles"]].assign(own=own, **{f"p{k}": parity[:, k] for k in range(4)})
        tidy()

    return classes.select("rep", "n_shingles", "shared").mapInPandas(make, "rep long, n_shingles long, own long, p0 long, p1 long, p2 long, p3 long")


def _compared(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """a, b, how many shingles they share, and whether they are linked."""

    def check(it):
        for pdf in it:
            both = [len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True)) for x, y in zip(pdf["x"], pdf["y"], strict=True)]
            out = pdf[["a", "b"]].assign(both=np.array(both, np.int64))
            yield out.assign(linked=den * out["both"] >= num * (pdf["m"] + pdf["n"] - out["both"]))
        tidy()

    left = classes.select(F.col("rep").alias("a"), F.col("n_shingles").alias("m"), F.col("shared").alias("x"))
    right = classes.select(F.col("rep").alias("b"), F.col("n_shingles").alias("n"), F.col("shared").alias("y"))
    return pairs.join(left, "a").join(right, "b").mapInPandas(check, "a long, b long, both long, linked boolean")


def ngram_jaccard(docs: DataFrame, n: int = 5, similarity: tuple[int, int] = (75, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links documents whose sets of n-word shingles have a Jaccard similarity of at least num / den.

    Words are A-Z lowered. Documents of equal sets are one representative. Shingles found in one document only
    can't be shared, so documents with too few others have no link and stop here. The rest are joined by the
    pigeonhole principle: in each size band the universe is partitioned by hash into segments; every set's
    segments, and its segments less one element, are indexed under its own band, and every set probes the bands
    of its size and less with the cheapest allotment that can't miss a linked set. Candidates are verified
    exactly (on 64-bit hashes of shingles).

    Pairs within a group are not emitted. Under each key, a set is first compared with the most typical set
    there only, its leader. Only what is then still in different classes under a key goes on, and of it only
    pairs that the rank of the key allows and that can be linked at all: two sets share at most the lesser part of what each shares with their
    leader, and the lesser part of what each has beside it. In a family of edited copies the leader is near the
    original, and copies too far from it have little beside it to share. Parities of both sets also bound how far they are apart. That is exact for classes: a candidate
    pair is in one class already, too far apart by this bound, or compared. Sets are told apart by 116 bits of a hash,
    their size and their share of shingles of their own. Repeated rows are copies; rows of null doc_id are joined like
    others, but no class is named after them.

    One row per input row: doc_id, n_shingles, component_id (least doc_id that it is linked with by links,
    itself included). Without words, or with null text: 0 shingles, linked with nothing. Very long texts are taken
    whole; an empty table gives no rows. Other columns are not read.
    """
    num, den = similarity
    scratch = Scratch()
    sets = scratch(_sets(docs, n, num, den, id_col, text_col))
    sweep(docs.sparkSession)
    classes = _classes(sets, scratch)
    named = scratch(sets.select("doc_id", "n_shingles", "rep", "name"))
    scratch.drop(sets)
    sweep(docs.sparkSession)
    rows = _keys(classes, num, den)
    met = rows.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.min(F.when(F.col("rank") < 0, F.col("rep"))).alias("leader"), F.max("rank").alias("rank"))
    live = scratch(rows.join(met.where("rank >= 0 AND low < high AND leader IS NOT NULL").select("key", "leader"), "key"))
    del rows, met
    sweep(docs.sparkSession)

    near = lambda rows: rows.where("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct()
    seen = scratch(_compared(near(live.where("rank >= 0")), classes, num, den))
    links = seen.where("linked").select("a", "b")
    rooted = live.join(components(links).withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "rank", "leader", F.coalesce("root", "rep").alias("root"))
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    rooted = scratch(rooted.join(open_keys, "key", "left_semi"))
    more = scratch(_compared(near(rooted).join(seen.select("a", "b"), ["a", "b"], "left_anti"), classes, num, den))
    links = links.unionByName(more.where("linked").select("a", "b"))
    rooted = rooted.drop("root").join(components(links).withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    beside = seen.unionByName(more).select(F.col("a").alias("rep"), F.col("b").alias("leader"), "both")
    placed = rooted.join(beside, ["rep", "leader"], "left").join(_sketched(classes), "rep").withColumn("both", F.coalesce("both", "own")).withColumn("rest", F.col("own") - F.col("both"))
    side = lambda df, x: df.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("rep", "root", "rank", "n_shingles", "own", "both", "rest", "p0", "p1", "p2", "p3")))
    at_most = F.least("both_a", "both_b") + F.least("rest_a", "rest_b")
    apart = F.floor((den - num) * (F.col("n_shingles_a") + F.col("n_shingles_b")) / (den + num)) - (F.col("n_shingles_a") - F.col("own_a")) - (F.col("n_shingles_b") - F.col("own_b"))
    parted = sum((F.bit_count(F.col(f"p{k}_a").bitwiseXOR(F.col(f"p{k}_b"))) for k in range(4)), F.lit(0))
    can = (F.col("rank_a") <= apart) & (parted <= apart) & (F.col("root_a") != F.col("root_b")) & (den * at_most >= num * (F.col("n_shingles_a") + F.col("n_shingles_b") - at_most))
    pairs = side(placed.where("rank >= 0"), "a").join(side(placed.where("rank < 0"), "b"), "key").where(can)
    pairs = pairs.select(F.greatest("rep_a", "rep_b").alias("a"), F.least("rep_a", "rep_b").alias("b")).distinct()
    links = links.unionByName(_compared(pairs, classes, num, den).where("linked").select("a", "b"))

    roots = components(links).withColumnRenamed("node", "rep")
    of = classes.select("rep", "first", "name", "n_shingles", "least").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    of = of.join(of.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(F.col("first").alias("rep"), "name", "n_shingles", "component_id")
    out = named.join(of, ["rep", "name", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = scratch.done(out)
    sweep(docs.sparkSession)
    return out
