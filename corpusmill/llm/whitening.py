"""Embedding whitening from bit-sliced scatter matrices.

Components become integers. Each dimension is shifted by its least value and cut into bit planes, and each plane is packed
across rows into words. The cross-product of two dimensions is the sum over pairs of their planes of the number of rows with
both bits, times the weights of the two bits: AND and popcount, all in integers. The covariance is centred as integers too and
becomes double only for eigh. What a task gives is a row for each pair of dimensions, whatever the number of its vectors, and
the driver gets such sums alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.slices import matrix, runs, usable

#: Vectors whose bit planes are packed at a time.
ROWS_AT_ONCE = 8192
#: Integers of more than 2**48 in size are cut to that.
LARGEST = 1 << 48
#: Components with less than this share of the largest eigenvalue have no variance to divide by.
NO_VARIANCE = 1e-12


def integers(m: np.ndarray, scale: int, shift: int) -> np.ndarray:
    """floor(scale * x) + shift."""
    return np.clip(np.floor(m * float(scale)), -LARGEST, LARGEST).astype(np.int64) + shift


def planes(y: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bit planes of each column, packed across rows into words: a row for each plane, by column and rising weight."""
    words = -(-len(y) // 64)
    out = np.zeros((sum(bits), words * 8), dtype=np.uint8)
    at = 0
    for d, n in enumerate(bits):
        for b in range(n):
            packed = np.packbits(((y[:, d] >> b) & 1).astype(np.uint8))
            out[at, : len(packed)] = packed
            at += 1
    return out.view(np.uint64)


def scatter(y: np.ndarray, bits: list[int]) -> np.ndarray:
    """Sums of products of all pairs of columns (the upper triangle) by AND and popcount of their planes."""
    kind = np.int64 if 2 * max(bits, default=0) + 14 <= 62 else object
    packed = planes(y, bits)
    weight = np.asarray([1 << b for n in bits for b in range(n)], dtype=kind)
    start = np.concatenate(([0], np.cumsum(bits))).astype(int)
    varied = np.flatnonzero(bits)
    total = np.zeros((len(bits), len(bits)), dtype=kind)
    for i, d in enumerate(varied):
        rest, edges = packed[start[d] :], start[varied[i:]] - start[d]
        for r in range(start[d], start[d + 1]):
            counts = np.bitwise_count(rest & packed[r]).sum(axis=1, dtype=np.int64).astype(kind)
            total[d, varied[i:]] += weight[r] * np.add.reduceat(weight[start[d] :] * counts, edges)
    return total


def _by_size(batches: Iterator[pa.RecordBatch], scale: int, shift: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Pieces of one vector length with their integer matrices."""
    for batch in batches:
        for (size,), piece in runs(batch, ["_size"]):
            yield size, piece, integers(matrix(piece), scale, shift)


def _sums(scale: int, shift: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for size, _, m in _by_size(batches, scale, shift):
            n, total, low, high = found.get(size, (0, 0, m[0], m[0]))
            found[size] = [n + len(m), total + m.sum(axis=0).astype(object), np.minimum(low, m.min(axis=0)), np.maximum(high, m.max(axis=0))]
        for size, (n, total, low, high) in found.items():
            yield pa.RecordBatch.from_pydict(
                {"size": pa.array([size] * size, pa.int32()), "d": pa.array(range(size), pa.int32()), "n": pa.array([n] * size, pa.int64()), "total": pa.array(map(Decimal, total), pa.decimal128(38, 0)), "low": low, "high": high}
            )

    return sums


def _scatters(scale: int, shift: int, low: dict[int, np.ndarray], bits: dict[int, list[int]]):
    def scatters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[np.ndarray]] = {}
        total: dict[int, np.ndarray] = {}

        def count(size: int) -> None:
            y = np.concatenate(waiting.pop(size)) - low[size]
            for at in range(0, len(y), ROWS_AT_ONCE):
                total[size] = total.get(size, 0) + scatter(y[at : at + ROWS_AT_ONCE], bits[size]).astype(object)

        for size, _, m in _by_size(batches, scale, shift):
            waiting.setdefault(size, []).append(m)
            if sum(map(len, waiting[size])) >= ROWS_AT_ONCE:
                count(size)
        for size in list(waiting):
            count(size)
        for size, sums in total.items():
            i, j = np.triu_indices(size)
            yield pa.RecordBatch.from_pydict({"size": pa.array([size] * len(i), pa.int32()), "i": i.astype(np.int32), "j": j.astype(np.int32), "total": pa.array(map(Decimal, sums[i, j]), pa.decimal128(38, 0))})

    return scatters


class Model:
    """Mean and components of the vectors of one length; ``identity_error`` is measured later."""

    def __init__(self, n: int, total: list[int], low: list[int], cross: np.ndarray, components: int):
        size = len(total)
        shifted = [s - n * b for s, b in zip(total, low)]
        centred = [[n * int(cross[min(i, j), max(i, j)]) - shifted[i] * shifted[j] for j in range(size)] for i in range(size)]
        values, vectors = np.linalg.eigh(np.asarray([[c / (n * n) for c in row] for row in centred]))
        order = np.argsort(-values, kind="stable")[:components]
        order = order[values[order] > NO_VARIANCE * max(values.max(), 0)]
        vectors = vectors[:, order]
        self.n, self.total, self.base = n, total, np.asarray([s // n for s in total], dtype=np.int64)
        self.rest = np.asarray([s % n for s in total], dtype=object)
        self.values, self.explained = values[order], values[order] / (sum(c[i] for i, c in enumerate(centred)) / (n * n) or 1)
        # the largest entry is positive, so that the signs are the same in each run
        self.vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))]) if len(order) else vectors
        self.identity_error = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        centred = (x - self.base).astype(np.float64) - (self.rest / self.n).astype(np.float64)
        return centred @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[Decimal]:
        """The sum of (n * x - total)**2 of each row, exact."""
        near = x - self.base
        largest = int(np.abs(near).max(initial=0)) * self.n + self.n
        kind = np.int64 if largest * largest * x.shape[1] < 1 << 62 else object
        return [Decimal(int(v)) for v in ((near.astype(kind) * self.n - self.rest.astype(kind)) ** 2).sum(axis=1)]


def _moments(scale: int, shift: int, models: dict[int, Model]):
    """Sums and cross-products of whitened vectors."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for size, _, m in _by_size(batches, scale, shift):
            z = np.concatenate((models[size].whitened(m), np.ones((len(m), 1))), axis=1)
            found[size] = found.get(size, 0) + z.T @ z
        for size, c in found.items():
            i, j = np.indices(c.shape).reshape(2, -1).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"size": pa.array([size] * len(i), pa.int32()), "i": i, "j": j, "total": c.reshape(-1)})

    return moments


def fit(rows: DataFrame, components: int, scale: int, shift: int) -> dict[int, Model]:
    """A model for each vector length of ``rows`` (``_size``, ``_v``)."""
    v = rows.select("_size", "_v")
    sums = v.mapInArrow(_sums(scale, shift), "size int, d int, n long, total decimal(38,0), low long, high long").groupBy("size", "d")
    by_size: dict[int, list] = {}
    for r in sums.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("size", "d").collect():
        by_size.setdefault(r["size"], []).append(r)
    low = {s: np.asarray([r["low"] for r in found], dtype=np.int64) for s, found in by_size.items()}
    bits = {s: [int(r["high"] - r["low"]).bit_length() for r in found] for s, found in by_size.items()}
    cross = {s: np.zeros((s, s), dtype=object) for s in by_size}
    for r in v.mapInArrow(_scatters(scale, shift, low, bits), "size int, i int, j int, total decimal(38,0)").groupBy("size", "i", "j").agg(F.sum("total").alias("total")).collect():
        cross[r["size"]][r["i"], r["j"]] = int(r["total"])
    models = {s: Model(found[0]["n"], [int(r["total"]) for r in found], low[s].tolist(), cross[s], components) for s, found in by_size.items()}
    seen = {s: np.zeros((len(m.values) + 1, len(m.values) + 1)) for s, m in models.items()}
    for r in v.mapInArrow(_moments(scale, shift, models), "size int, i int, j int, total double").groupBy("size", "i", "j").agg(F.sum("total").alias("total")).collect():
        seen[r["size"]][r["i"], r["j"]] = r["total"]
    for s, m in models.items():
        mean = seen[s][:-1, -1] / m.n
        m.identity_error = float(np.abs(seen[s][:-1, :-1] / m.n - np.outer(mean, mean) - np.eye(len(mean))).max(initial=0))
    return models


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each vector and component.

    A vector's components become floor(scale * c) + shift. All vectors are fitted: n of them, covariance with divisor n,
    components by falling eigenvalue from 1 with the largest entry of each positive. ``whitened`` is the centred vector on
    the component over the root of its eigenvalue, ``explained`` the eigenvalue's share of the trace, ``deviation`` the exact
    sum over dimensions of (n * x - sum)**2, and ``identity_error`` how far the covariance of all whitened vectors, measured
    after the fact, is from the identity. Null and empty vectors and those with null or non-finite entries go. Components
    without variance have no rows, so a single vector, equal vectors or an empty table give none. Vectors of each length are
    a fit of their own. Repeated rows each count, null ids stay, and other columns, whatever their names, play no part.
    Integers are exact up to 2**48.
    """
    v = F.col(vector_col)
    rows = vectors.where(usable(v)).select(F.col(id_col).cast("long").alias("_id"), F.size(v).alias("_size"), F.transform(v, lambda x: x.cast("double")).alias("_v"))
    models = fit(rows, components, scale, shift)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, piece, x in _by_size(batches, scale, shift):
            m = models[size]
            z, k = m.whitened(x), len(m.values)
            if k:
                again = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": piece.column("_id").take(pa.array(again)),
                        "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)),
                        "n": np.full(len(again), m.n, dtype=np.int64),
                        "deviation": pa.array(m.deviation(x), pa.decimal128(38, 0)).take(pa.array(again)),
                        "whitened": z.reshape(-1),
                        "explained": np.tile(m.explained, len(x)),
                        "identity_error": np.full(len(again), m.identity_error),
                    }
                )

    return rows.mapInArrow(project, "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
