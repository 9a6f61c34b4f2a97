"""Global statistics of hashed keys without a row per key.

Documents are dealt into chunks of a few MB of text by their place in the input, so no id, text or source makes a
chunk large. A chunk sends each distinct key once, with a small number beside it, to the bucket of the key's leading
bits; keys of one message are sorted and stored as byte planes of their differences. A bucket merges its messages and
answers every chunk that sent a key. So a key in a third of all documents costs one entry per chunk, no task sees more
than a bucket or a chunk, and texts are shuffled once: all steps of an operator read the same exchange.

Chunks and buckets grow with the corpus, partitions only up to PARTITIONS. A message from each chunk to each bucket would become one key. Where there are more
than 2 ** HOP_BITS buckets, messages go through relays, each for some chunks and some buckets, there and back: a chunk
then writes to as many relays as the square root of the number of buckets, and so does a relay.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import stored
from .text import tidy

CHUNK_BYTES = 6 << 20
#: Partitions of a shuffle at most. Chunks beyond lie one after the other in a partition, ordered by number, and are still taken one at a time.
PARTITIONS = 20_000
BUCKET_KEYS = 1 << 21
#: Bits of a bucket's number up to which chunks write to buckets themselves.
HOP_BITS = 12
MESSAGE = "chunk long, bucket int, size long, keys binary, vals binary"
#: Keys that look_up takes at once.
_AT_ONCE = 1 << 19
_NAMES = ["chunk", "bucket", "size", "keys", "vals"]


def measure(docs: DataFrame, text: str = "text", **more: Column) -> dict:
    """Bytes of all texts, and whatever else is to be summed in the same scan."""
    row = docs.agg(F.sum(F.octet_length(F.col(text))).alias("bytes"), *(F.sum(c).alias(k) for k, c in more.items())).first()
    return {k: int(v or 0) for k, v in row.asDict().items()}


def carried(carry: tuple[str, ...]) -> list[Column]:
    """Columns that an operator hands through, under names of their own."""
    return [F.col(c).alias(f"carry_{k}") for k, c in enumerate(carry)]


def handed(df: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """The result of an operator with the carried columns under their names."""
    return df.withColumnsRenamed({f"carry_{k}": c for k, c in enumerate(carry)})


def kinds(df: DataFrame) -> str:
    """The carried columns as the end of a schema."""
    return "".join(f", {f.name} {f.dataType.simpleString()}" for f in df.schema if f.name.startswith("carry_"))


def chunked(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Columns chunk, doc_id and text, and those carried, dealt by chunk. Rows are dealt by place, whatever they hold."""
    n = max(1, math.ceil(size / chunk_bytes))
    key = F.xxhash64(F.monotonically_increasing_id())
    rows = settled(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *carried(carry)))
    return rows.withColumn("chunk", F.pmod(key, F.lit(n))).repartition(min(n, PARTITIONS), "chunk")


def settled(docs: DataFrame) -> DataFrame:
    """docs, or a table of its rows where these come out of a shuffle: a task that is run again may get them in another order, and a row's place must not change."""
    return stored(docs) if "Exchange" in docs._jdf.queryExecution().executedPlan().toString() else docs


def buckets(size: int) -> int:
    """Bits of a key that name its bucket, for about so many keys in all."""
    return max(3, math.ceil(math.log2(max(1, size / BUCKET_KEYS))))


def _planes(x: np.ndarray) -> bytes:
    """The width of a number in bytes (0: one bit each), then the first bytes of all, the second bytes of all, and so on."""
    top = int(x.max()) if len(x) else 0
    if top < 2:
        return b"\0" + np.packbits(x.astype(bool)).tobytes()
    width = (top.bit_length() + 7) // 8
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(raw: bytes, size: int) -> np.ndarray:
    out = np.zeros((size, 8), np.uint8)
    if size and raw[0]:
        out[:, : raw[0]] = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], size).T
    elif size:
        out[:, 0] = np.unpackbits(np.frombuffer(raw, np.uint8, offset=1), count=size)
    return out.view("<u8").reshape(-1)


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def unpack(raw: bytes, size: int) -> np.ndarray:
    return np.cumsum(_unplanes(raw, size), dtype=np.uint64)


def near(bits: int) -> int:
    """Bits by which chunks deal their keys: all that name a bucket, or half of them where relays deal by the rest."""
    return bits if bits <= HOP_BITS else (bits + 1) // 2


def _cut(keys: np.ndarray, shift: int) -> Iterator[tuple[int, int, int]]:
    """Runs of sorted keys with the same bits above shift: these bits, start and end."""
    of = (keys >> np.uint64(shift)).astype(np.int64)
    edge = np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(of)] if len(of) else np.zeros(1, int)
    return zip(of[edge[:-1]].tolist(), edge.tolist(), edge[1:].tolist(), strict=False)


def messages(chunk: int, keys: np.ndarray, vals: np.ndarray, bits: int, width: int = 64) -> pd.DataFrame:
    """Distinct sorted keys of so many bits with their numbers, cut by bucket. Keys lose nothing: a bucket's base is put back on reading."""
    shift = width - near(bits)
    rows = [(chunk, b, e - s, pack(keys[s:e] - (np.uint64(b) << np.uint64(shift))), _planes(vals[s:e])) for b, s, e in _cut(keys, shift)]
    return pd.DataFrame(rows, columns=_NAMES) if rows else _nothing()


def distinct(keys: np.ndarray) -> np.ndarray:
    """Distinct keys in order (np.unique hashes keys, which is slow)."""
    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def tally(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of their weights, or their count."""
    if not len(keys):
        return keys, np.zeros(0, np.uint64)
    if weights is None:
        found, count = np.unique(keys, return_counts=True)
        return found, count.astype(np.uint64)
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(weights, first)


def answers(sent: DataFrame, merge: Callable[[np.ndarray, np.ndarray], np.ndarray] | None, least: int, bits: int, in_order: bool = False, width: int = 64) -> DataFrame:
    """For every message the keys whose merged number is at least least, with that number.

    merge turns (numbers in key order, starts of keys) into one number a key; by default it adds. in_order: the
    answer has no keys but a number, 0 if below least, for each key in the order sent.
    """
    far = bits - near(bits)
    rest = width - bits

    def reduce(key, pdf):
        sizes = pdf["size"].to_numpy()
        keys = np.concatenate([unpack(k, n) for k, n in zip(pdf["keys"], sizes, strict=True)])
        vals = np.concatenate([_unplanes(v, n) for v, n in zip(pdf["vals"], sizes, strict=True)])
        order = np.argsort(keys)
        ordered = keys[order]
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        total = np.add.reduceat(vals[order], first) if merge is None else merge(vals[order], first)
        mine = np.empty(len(keys), np.uint64)
        mine[order] = np.repeat(total, np.diff(np.r_[first, len(keys)]))
        rows, at = [], 0
        owners = pdf["owners"] if far else [b""] * len(pdf)
        for chunk, n, owner in zip(pdf["chunk"], sizes, owners, strict=True):
            k, v = keys[at : at + n], mine[at : at + n]
            at += n
            keep = v >= least
            if in_order:
                rows.append((chunk, key[0], n, b"", _planes(v * keep), owner))
            elif keep.any():
                rows.append((chunk, key[0], int(keep.sum()), pack(k[keep]), _planes(v[keep]), _planes(_unplanes(owner, n)[keep]) if far else owner))
        tidy()
        return pd.DataFrame(rows, columns=[*_NAMES, "owners"]) if rows else _nothing().assign(owners=pd.Series(dtype=object))

    def there(key, pdf):
        """From some chunks with some leading bits to all buckets below these."""
        parts = [unpack(k, n) for k, n in zip(pdf["keys"], pdf["size"], strict=True)]
        keys, vals = np.concatenate(parts), np.concatenate([_unplanes(v, n) for v, n in zip(pdf["vals"], pdf["size"], strict=True)])
        owners = np.repeat((pdf["chunk"] & ((1 << far) - 1)).to_numpy(np.uint64), [len(x) for x in parts])
        order = np.argsort(keys)
        keys, vals, owners = keys[order], vals[order], owners[order]
        rows = [(key[0], key[1] << far | b, e - s, pack(keys[s:e] - (np.uint64(b) << np.uint64(rest))), _planes(vals[s:e]), _planes(owners[s:e])) for b, s, e in _cut(keys, rest)]
        tidy()
        return pd.DataFrame(rows, columns=[*_NAMES, "owners"])

    def back(key, pdf):
        """From these buckets to the chunks, each one's keys in order."""
        pdf = pdf.sort_values("bucket")
        sizes = pdf["size"].tolist()
        vals, owners = (np.concatenate([_unplanes(v, n) for v, n in zip(pdf[c], sizes, strict=True)]) for c in ("vals", "owners"))
        keys = np.zeros(0, np.uint64)
        if not in_order:
            keys = np.concatenate([unpack(k, n) + (np.uint64(b & ((1 << far) - 1)) << np.uint64(rest)) for k, n, b in zip(pdf["keys"], sizes, pdf["bucket"].tolist(), strict=True)])
        order = np.argsort(owners, kind="stable")
        rows = [(key[0] << far | o, key[1], e - s, b"" if in_order else pack(keys[order[s:e]]), _planes(vals[order[s:e]])) for o, s, e in _cut(owners[order], 0)]
        tidy()
        return pd.DataFrame(rows, columns=_NAMES)

    if not far:
        return sent.groupBy("bucket").applyInPandas(reduce, MESSAGE + ", owners binary").drop("owners")
    dealt = sent.groupBy(F.shiftright("chunk", far).alias("gang"), "bucket").applyInPandas(there, MESSAGE + ", owners binary")
    merged = dealt.groupBy("bucket").applyInPandas(reduce, MESSAGE + ", owners binary")
    return merged.groupBy(F.col("chunk").alias("gang"), F.shiftright("bucket", far).alias("leading")).applyInPandas(back, MESSAGE)


def _nothing() -> pd.DataFrame:
    return pd.DataFrame({"chunk": pd.Series(dtype="int64"), "bucket": pd.Series(dtype="int32"), "size": pd.Series(dtype="int64"), "keys": pd.Series(dtype=object), "vals": pd.Series(dtype=object)})


def numbers(answer: pd.DataFrame) -> np.ndarray:
    """Of an answer in order: the numbers of all keys that the chunk sent."""
    answer = answer.sort_values("bucket")
    return np.concatenate([np.zeros(0, np.uint64), *(_unplanes(v, n) for v, n in zip(answer["vals"], answer["size"], strict=True))])


def read(answer: pd.DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All keys that a chunk got back, in order, and their numbers."""
    if not len(answer):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    answer = answer.sort_values("bucket")
    shift = np.uint64(64 - near(bits))
    keys = [unpack(k, n) + (np.uint64(b) << shift) for b, n, k in zip(answer["bucket"], answer["size"], answer["keys"], strict=True)]
    return np.concatenate(keys), np.concatenate([_unplanes(v, n) for v, n in zip(answer["vals"], answer["size"], strict=True)])


def look_up(keys: np.ndarray, known: np.ndarray, vals: np.ndarray | None = None) -> np.ndarray:
    """Whether each key is known, or its number (0: not known). known is in order.

    A table of the leading bits says where known keys that begin alike are: one or two as keys are hashes, which is faster than a search.
    """
    out = np.zeros(len(keys), bool if vals is None else np.uint64)
    if not len(known):
        return out
    bits = min(24, max(8, len(known).bit_length() + 1))
    shift = np.uint64(64 - bits)
    first = np.zeros((1 << bits) + 1, np.int32)
    np.cumsum(np.bincount((known >> shift).astype(np.int64), minlength=1 << bits), dtype=np.int32, out=first[1:])
    for begin in range(0, len(keys), _AT_ONCE):
        own = keys[begin : begin + _AT_ONCE]
        lead = (own >> shift).astype(np.int64)
        at, end = first[lead], first[lead + 1]
        live = np.flatnonzero(at < end)
        at, end, own = at[live], end[live], own[live]
        while len(live):
            there = known[at]
            hit = there == own
            out[begin + live[hit]] = True if vals is None else vals[at[hit]]
            at = at + 1
            more = (there < own) & (at < end)
            live, at, end, own = live[more], at[more], end[more], own[more]
    return out


#: Added to the buckets of a second answer, where a chunk reads two.
_SECOND = 1 << 28


def both(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two answers as one."""
    return first.unionByName(second.withColumn("bucket", F.col("bucket") + _SECOND))


def each(answer: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The two again."""
    later = answer["bucket"] >= _SECOND
    return answer[~later], answer[later].assign(bucket=answer["bucket"][later] - _SECOND)


def send(docs: DataFrame, emit: Callable, bits: int, answer: DataFrame | None = None, read_by: Callable | None = None, width: int = 64) -> DataFrame:
    """emit(pdf) or emit(pdf, *what the chunk reads in its answer) gives a chunk's distinct sorted keys and their numbers.

    An answer is read as keys and numbers, or by read_by.
    """
    read_by = read_by or (lambda a: read(a, bits))

    def alone(key, pdf):
        out = messages(key[0], *emit(pdf), bits, width)
        tidy()
        return out

    def answered(key, left, right):
        out = messages(key[0], *emit(left, *read_by(right)), bits, width) if len(left) else _nothing()
        tidy()
        return out

    if answer is None:
        return docs.groupBy("chunk").applyInPandas(alone, MESSAGE)
    return docs.groupBy("chunk").cogroup(answer.groupBy("chunk")).applyInPandas(answered, MESSAGE)


def finish(docs: DataFrame, answer: DataFrame, make: Callable, schema: str, bits: int, read_by: Callable | None = None) -> DataFrame:
    """make(pdf, *what the chunk reads in its answer) gives a chunk's rows."""
    read_by = read_by or (lambda a: read(a, bits))

    def made(left, right):
        out = make(left, *read_by(right))
        tidy()
        return out

    return docs.groupBy("chunk").cogroup(answer.groupBy("chunk")).applyInPandas(made, schema)


def pieces(docs: Iterator[pd.DataFrame], rows: int = 500, chars: int = 4 << 20) -> Iterator[pd.DataFrame]:
    """The same rows in smaller frames, of about so many characters of text or of one longer text, so that what is made of them stays small."""
    for pdf in docs:
        if "text" in pdf:
            of = pdf["text"].str.len().fillna(0).to_numpy(np.int64).cumsum() // chars
            edge = np.r_[0, np.flatnonzero(np.diff(of)) + 1, len(pdf)]
        else:
            edge = np.array([0, len(pdf)])
        for s, e in zip(edge.tolist(), edge[1:].tolist(), strict=False):
            for at in range(s, e, rows):
                yield pdf.iloc[at : min(at + rows, e)]
