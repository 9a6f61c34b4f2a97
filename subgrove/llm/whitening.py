"""Whitening of embeddings by their leading principal components, found by a randomised range finder."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Scratch
from .text import tidy

#: Numbers of a block of rows that is in work at once.
BLOCK = 1 << 20
#: Dimensions up to which a failed range goes to full dimension at once; beyond, it doubles.
FULL = 1024
_EPS = float(np.finfo(float).eps)


def _blocks(it: Iterator[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into blocks, whatever the length of their vectors."""
    for batch in it:
        sizes = pc.fill_null(pc.list_value_length(batch.column(place)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // BLOCK
        edge = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        for s, e in zip(edge, edge[1:], strict=False):
            if e > s:
                yield batch.slice(s, e - s)


def _integers(vectors: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length that vectors have: the rows of such vectors that hold no null or non-finite entry, and their entries times scale, rounded down."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        flat = vectors.take(pa.array(rows)).flatten().cast(pa.float64())
        x = np.floor(flat.to_numpy(zero_copy_only=False).reshape(-1, d) * scale)  # null entries are NaN
        good = (np.abs(x) < 2.0**62).all(axis=1)  # false for NaN and infinite ones
        yield rows[good], x[good].astype(np.int64)


def _packed(x: np.ndarray) -> list[bytes]:
    """Each row by the least width that holds it, the same for equal rows."""
    most, out = np.abs(x).max(axis=1), np.empty(len(x), object)
    for kind, low, high in (("<i2", -1, 1 << 15), ("<i4", (1 << 15) - 1, 1 << 31), ("<i8", (1 << 31) - 1, 1 << 63)):
        some = np.flatnonzero((most > low) & (most < high))
        size = x.shape[1] * int(kind[2])
        raw = x[some].astype(kind).tobytes()
        out[some] = [raw[k : k + size] for k in range(0, len(raw), size)]
    return out.tolist()


def _unpacked(raw: pa.Array, d: int) -> np.ndarray:
    sizes, out = pc.binary_length(raw).to_numpy(zero_copy_only=False), np.zeros((len(raw), d), np.int64)
    for width in (2, 4, 8):
        some = np.flatnonzero(sizes == d * width)
        if len(some):
            out[some] = np.frombuffer(b"".join(raw.take(pa.array(some)).to_pylist()), f"<i{width}").reshape(-1, d)
    return out


def _fit_list(vectors: DataFrame, scale: int, vector_col: str) -> DataFrame:
    """d and x: each distinct vector of integers once, packed; equal ones meet in the map tasks first."""

    def pack(it: Iterator[pa.RecordBatch]):
        for batch in _blocks(it, 0):
            for _, x in _integers(batch.column(0), scale):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1]), pa.int32()), pa.array(_packed(x), pa.binary())], ["d", "x"])
        tidy()

    return vectors.select(F.col(vector_col).alias("vector")).where("vector IS NOT NULL").mapInArrow(pack, "d int, x binary").distinct()


def _moments(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many rows, and the exact sum of each dimension: high and low halves are summed apart."""

    def add(it: Iterator[pa.RecordBatch]):
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in it:
            for at in range(0, batch.num_rows, max(1, BLOCK // d)):
                x = _unpacked(batch.column(0).slice(at, max(1, BLOCK // d)), d)
                n, high, low = n + len(x), high + (x >> 31).sum(axis=0), low + (x & ((1 << 31) - 1)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(np.full(d, n), pa.int64()), pa.array(high), pa.array(low)], ["i", "n", "high", "low"])

    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = fit.select("x").mapInArrow(add, "i int, n long, high long, low long").groupBy("i").agg(F.sum("n").alias("n"), whole("high"), whole("low")).orderBy("i").collect()
    return rows[0]["n"], [(int(r["high"]) << 31) + int(r["low"]) for r in rows]


def _products(fit: DataFrame, mean: np.ndarray, right: np.ndarray, left: np.ndarray | None = None) -> np.ndarray:
    """The sum over rows of (x - mean) (x - mean)' right, or with left' before it; the last column holds the sums of squares (of left' x)."""
    d, m = len(mean), len(mean) if left is None else left.shape[1]

    def add(it: Iterator[pa.RecordBatch]):
        total = np.zeros((m, right.shape[1] + 1))
        for batch in it:
            for at in range(0, batch.num_rows, max(1, BLOCK // d)):
                x = _unpacked(batch.column(0).slice(at, max(1, BLOCK // d)), d) - mean
                own = x if left is None else x @ left
                total[:, :-1] += own.T @ (x @ right)
                total[:, -1] += (own * own).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "sums"])

    def meet(key, pdf):
        return pd.DataFrame({"i": [key[0]], "sums": [np.sum([np.frombuffer(s) for s in pdf["sums"]], axis=0).tobytes()]})

    rows = fit.select("x").mapInArrow(add, "i int, sums binary").groupBy("i").applyInPandas(meet, "i int, sums binary").collect()  # a row for each dimension
    return np.array([np.frombuffer(r["sums"]) for r in sorted(rows, key=lambda r: r["i"])])


@dataclass(frozen=True)
class Whitening:
    """The fit list's number of rows n and exact sums, the leading components (columns of axes) with their variances, the variance of all
    dimensions, and the largest absolute entry of the whitened fit list's covariance minus the identity. passes: over the fit list, for the components."""

    scale: int
    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0
    passes: int = 0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def usable(self) -> np.ndarray:
        """Components that vary at all."""
        return self.values > 8 * _EPS * len(self.sums) * max(self.trace, 0.0)

    def explained(self) -> list[float | None]:
        return [float(v / self.trace) if self.trace > 0 else None for v in self.values]

    def projection(self) -> np.ndarray:
        return self.axes / np.sqrt(np.where(self.usable, self.values, 1.0))

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Of each row, the exact sum over dimensions of (n x - sum) squared."""
        most = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums))
        kind = pa.decimal128(38, 0)
        if most * most * len(self.sums) < 1 << 63:
            y = x * self.n - np.array(self.sums, np.int64)
            return pa.array((y * y).sum(axis=1)).cast(kind)
        y = x.astype(object) * self.n - np.array(self.sums, object)
        return pa.array([Decimal(int(v)) for v in (y * y).sum(axis=1)], kind)


def _components(fit: DataFrame, mean: np.ndarray, n: int, k: int, oversample: int, powers: int, tolerance: float, seed: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The k leading eigenvectors and eigenvalues of the covariance, its trace, and how many passes were made."""
    d, rng = len(mean), np.random.default_rng(seed)
    width, at_width, passes = min(d, k + oversample), 0, 0
    basis = np.linalg.qr(rng.normal(size=(d, width)))[0] if width < d else np.eye(d)
    while True:
        sums = _products(fit, mean, basis) / n
        image, trace, passes, at_width = sums[:, :-1], float(sums[:, -1].sum()), passes + 1, at_width + 1
        ritz = basis.T @ image
        values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        axes = (basis @ turn)[:, :k]
        residual = np.linalg.norm((image @ turn)[:, :k] - axes * values[:k], axis=0)
        gap = np.array([np.abs(np.delete(values, j) - values[j]).min(initial=np.inf) for j in range(min(k, len(values)))])
        if width == d or (residual <= np.maximum(tolerance * gap, 32 * _EPS * values[0])).all():
            return axes, np.maximum(values[:k], 0.0), trace, passes
        if at_width <= powers:
            basis = np.linalg.qr(image)[0]
            continue
        width, at_width = d if d <= FULL else min(d, 2 * width), 0
        basis = np.eye(d) if width == d else np.linalg.qr(np.c_[image, rng.normal(size=(d, width - image.shape[1]))])[0]


def fit_whitening(vectors: DataFrame, k: int = 4, scale: int = 256, oversample: int = 8, powers: int = 2, tolerance: float = 1e-11, seed: int = 12, vector_col: str = "embedding") -> Whitening | None:
    """The k leading components of all distinct vectors, whose entries are taken times scale and rounded down.

    A random range of k + oversample directions is multiplied by the covariance of the centred rows, pass after pass
    over all of them; Rayleigh-Ritz gives the components in it. Where, after powers passes more, a component's residual is not below tolerance
    times the distance to the next value, the range is expanded (to full dimension, or above FULL dimensions doubled until it is full); in full
    dimension the components are exact to rounding. Sums are made in the tasks and met by dimension, so the driver gets one row a dimension.

    Vectors that are null, empty, or hold null or non-finite entries (or such that exceed 62 bits) are left out, and so are those
    not of the commonest length among distinct ones (of equally common lengths, the longest). None where nothing is left.
    """
    scratch, spark = Scratch(), vectors.sparkSession
    fit = scratch(_fit_list(vectors, scale, vector_col))
    lengths = fit.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        scratch.less(spark)
        return None
    d = lengths["d"]
    fit = fit.where(F.col("d") == d)
    n, sums = _moments(fit, d)
    mean = np.array([s / n for s in sums])
    axes, values, trace, passes = _components(fit, mean, n, min(k, d), oversample, powers, tolerance, seed)
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    model = Whitening(scale, n, tuple(sums), axes, values, trace, passes=passes)
    side = model.projection()[:, model.usable]
    error = float(np.abs(_products(fit, mean, side, side)[:, :-1] / n - np.eye(side.shape[1])).max()) if side.shape[1] else 0.0
    scratch.less(spark)
    return Whitening(scale, n, tuple(sums), axes, values, trace, error, passes)


def whitened(vectors: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, deviation (the exact sum over dimensions of (n x - sum) squared) and whitened (a number for each component) of each row that fit_whitening() takes.

    Null in whitened stands for a component that does not vary in the fit list. Rows of null id and repeated rows are
    returned like others; an empty table, or no model, gives no rows. Other columns are not read.
    """
    rows = vectors.select(F.col(vector_col).alias("vector"), F.col(id_col).alias("vec_id"))
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    mean, side, d = model.mean, model.projection(), len(model.sums)

    def project(it: Iterator[pa.RecordBatch]):
        for batch in _blocks(it, 0):
            for own, x in _integers(batch.column(0), model.scale):
                if x.shape[1] == d:
                    out = (x - mean) @ side
                    hidden = np.broadcast_to(~model.usable, out.shape).reshape(-1)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * side.shape[1], pa.int32()), pa.array(out.reshape(-1), mask=hidden))
                    yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(own)), model.deviations(x), lists], ["vec_id", "deviation", "whitened"])
        tidy()

    return rows.where("vector IS NOT NULL").mapInArrow(project, schema)
