"""Token ids in files of 64-bit words, each holding as many ids as fit (Simple-8b)."""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import exchange as X
from .components import shared_folder
from .text import tidy
from .tokens import closed, encoder, slices

# Fixed values of the format: by selector (the top 4 bits of a word), values in a word and bits of each.
# Selector 0 is an escape: the word's other bits are a place in the file's list of whole 64-bit values.
COUNTS = (1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)

MAGIC, BLOCK, FILE_IDS = b"S8B1", 4096, 1 << 19
_HEADER = struct.Struct("<4sIQQQQ")
_COUNT, _BIT = np.array(COUNTS, np.int64), np.array(BITS, np.uint64)
_ESCAPE = np.uint64((1 << 60) - 1)
#: Zeros after each block, so that its last word can reach over its end.
_PAD = max(COUNTS)


def _selectors(data: np.ndarray) -> np.ndarray:
    """For each place of each row, the first selector whose width holds as many values from there on."""
    need = np.zeros(data.shape, np.uint8)  # selectors too narrow for a value
    top = int(data.max(initial=0))
    for s in range(1, 15):
        if top < 1 << BITS[s]:
            break
        need += data >= np.uint64(1) << _BIT[s]
    best = np.where(need < 14, np.uint8(14), np.uint8(0))
    reach, seen = need.copy(), 1  # the largest need in the next seen places
    for s in range(13, 0, -1):
        step = COUNTS[s] - seen
        np.maximum(reach[:, :-step], reach[:, step:], out=reach[:, :-step])
        seen = COUNTS[s]
        fits = reach < s
        if not fits.any():
            break
        best[fits] = s
    return best


def encode(values: np.ndarray) -> bytes:
    """A file: header (magic, values in a block, values, blocks, words, escapes), the word at which each block
    begins, words, escaped values. Blocks are coded apart, so each can be decoded alone."""
    values = np.asarray(values)
    size = len(values)
    blocks = -(-size // BLOCK)
    if not blocks:
        return _HEADER.pack(MAGIC, BLOCK, 0, 0, 0, 0) + np.zeros(1, "<u8").tobytes()
    width = BLOCK + _PAD
    data = np.zeros((blocks, width), np.uint64)
    full = size // BLOCK
    data[:full, :BLOCK] = values[: full * BLOCK].reshape(full, BLOCK)
    data[full:, : size - full * BLOCK] = values[full * BLOCK :]
    best, data = _selectors(data).ravel(), data.ravel()
    hop = _COUNT[best]
    row = np.arange(blocks)
    at, end = row * width, row * width + np.minimum(BLOCK, size - row * BLOCK)
    steps = []
    while (live := at < end).any():  # one word of every block at a time; done blocks stand still
        steps.append(np.where(live, at, -1))
        at = np.where(live, at + hop[at], at)
    table = np.stack(steps, axis=1)
    first = np.zeros(blocks + 1, "<u8")
    first[1:] = np.cumsum((table >= 0).sum(axis=1))
    place = table[table >= 0]
    sel = best[place]
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in range(1, 15):
        mine = np.flatnonzero(sel == s)
        if len(mine):
            begin = place[mine]
            own = data[begin]
            for k in range(1, COUNTS[s]):
                own |= data[begin + k] << np.uint64(k * BITS[s])
            words[mine] |= own
    escaped = np.flatnonzero(sel == 0)
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64)
    return _HEADER.pack(MAGIC, BLOCK, size, blocks, len(words), len(escaped)) + first.tobytes() + words.astype("<u8").tobytes() + data[place[escaped]].astype("<u8").tobytes()


def decode(raw: bytes, blocks: range | None = None) -> np.ndarray:
    """The values of a file, or of a range of its blocks, all words at once."""
    magic, block, size, n, n_words, n_escaped = _HEADER.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b file")
    first = np.frombuffer(raw, "<u8", n + 1, _HEADER.size).astype(np.int64)
    escapes = np.frombuffer(raw, "<u8", n_escaped, _HEADER.size + 8 * (n + 1 + n_words))
    lo, hi = (0, n) if blocks is None else (blocks.start, blocks.stop)
    words = np.frombuffer(raw, "<u8", n_words, _HEADER.size + 8 * (n + 1))[first[lo] : first[hi]]
    size = min(size, hi * block) - lo * block
    sel = (words >> np.uint64(60)).astype(np.uint8)
    if hi <= lo:
        return np.zeros(0, np.uint64)
    count = _COUNT[sel]
    before = np.cumsum(count) - count
    owner = np.repeat(np.arange(hi - lo), np.diff(first[lo : hi + 1]))
    width = block + _PAD
    place = owner * width + before - before[first[lo:hi] - first[lo]][owner]
    out = np.zeros((hi - lo, width), np.uint64)
    flat = out.reshape(-1)
    for s in range(1, 15):
        mine = np.flatnonzero(sel == s)
        if len(mine):
            begin, own, mask = place[mine], words[mine], np.uint64((1 << BITS[s]) - 1)
            for k in range(COUNTS[s]):
                flat[begin + k] = own >> np.uint64(k * BITS[s]) & mask
    mine = np.flatnonzero(sel == 0)
    flat[place[mine]] = escapes[(words[mine] & _ESCAPE).astype(np.int64)]
    return out[:, :block].reshape(-1)[:size]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Tokenizes whole texts and writes their ids, each document's followed by end_id, in ascending order of id.

    Documents are dealt by ranges of their id, so shards follow one another; each shard is cut into files of
    about half a million ids at document ends. A file is a row (shard, file, n_ids, docs, data) of a Parquet table at
    path, so that any store that Spark writes will do; docs names each document and its number of ids. Null and
    empty texts have end_id only; null ids come first; rows of one id, and those of null id, are ordered by a hash
    of their text, then by place, and may lie in several shards, so no id makes a shard large. Very long texts are
    encoded whole, one at a time, into one file each. An empty table writes no file. Other columns are not read.
    Returns path.
    """
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/subgrove-{uuid.uuid4().hex}"
    size = X.measure(docs, text_col)["bytes"]
    kind = docs.schema[id_col].dataType.simpleString()

    def encoded(it):
        shard = TaskContext.get().partitionId()
        number, held, names, sizes, ids_held = 0, [], [], [], 0
        own = encoder(tokenizer)

        def file():
            ids, docs_of, n = np.concatenate(held), pa.concat_arrays(names), np.concatenate(sizes)
            inner = pa.StructArray.from_arrays([docs_of, pa.array(n)], names=["doc_id", "n"])
            row = [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)]), pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), inner), pa.array([encode(ids)])]
            return pa.RecordBatch.from_arrays(row, names=["shard", "file", "n_ids", "docs", "data"])

        for batch in slices(it):
            ids, at = closed(*own.encode(batch.column(1)), end_id)
            s = 0
            while s < batch.num_rows:  # as many documents as it takes to fill a file
                e = min(batch.num_rows, int(np.searchsorted(at, at[s] + FILE_IDS - ids_held)))
                held.append(ids[at[s] : at[e]])
                names.append(batch.column(0).slice(s, e - s))
                sizes.append(np.diff(at[s : e + 1]))
                ids_held += int(at[e] - at[s])
                if ids_held >= FILE_IDS:
                    yield file()
                    number, held, names, sizes, ids_held = number + 1, [], [], [], 0
                s = e
        if held:
            yield file()
        del held, names, sizes
        tidy()

    tied = [F.xxhash64(F.col(text_col)).alias("tie"), F.monotonically_increasing_id().alias("row")]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *tied)
    dealt = rows.repartitionByRange(min(max(1, -(-size // (24 << 20))), X.PARTITIONS), "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "text")
    dealt.mapInArrow(encoded, f"shard int, file int, n_ids long, docs array<struct<doc_id:{kind},n:long>>, data binary").write.parquet(path)
    return path


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if wanted, ids, decoded from the files."""
    table = spark.read.parquet(path)
    kind = table.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()
    files = table.select("shard", "file", "n_ids")
    in_shard = files.withColumn("start", F.sum("n_ids").over(W.partitionBy("shard").orderBy("file")) - F.col("n_ids"))
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("base", F.sum("n").over(W.orderBy("shard")) - F.col("n"))
    starts = in_shard.join(shards.select("shard", "base"), "shard").select("shard", "file", (F.col("base") + F.col("start")).alias("first"))

    def decoded(it):
        for batch in it:
            for k in range(batch.num_rows):
                shard, file, docs, data = (c[k] for c in batch.columns)
                names, n = docs.values.field("doc_id"), docs.values.field("n").to_numpy()
                ids = decode(data.as_buffer()).astype("<u4")
                at = np.zeros(len(n) + 1, np.int64)
                np.cumsum(n, out=at[1:])
                crc = np.fromiter((zlib.crc32(ids[s:e]) for s, e in zip(at, at[1:], strict=False)), np.int64, len(n))
                columns = [pa.repeat(shard, len(n)), pa.repeat(file, len(n)), names, pa.array(at[:-1]), pa.array(n), pa.array(crc)]
                if with_ids:
                    columns.append(pa.LargeListArray.from_arrays(pa.array(at), pa.array(ids.astype(np.int64))).cast(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "file", "doc_id", "place", "n_tokens", "ids_crc32", "ids"][: 6 + with_ids])
        tidy()

    rows = table.select("shard", "file", "docs", "data").mapInArrow(decoded, f"shard int, file int, doc_id {kind}, place long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    columns = ["n_tokens", "ids_crc32", *(["ids"] * with_ids)]
    return rows.join(starts, ["shard", "file"]).select("doc_id", (F.col("first") + F.col("place")).alias("start"), *columns)
