"""Queries streamed past slices of a table of vectors.

The table is dealt once into slices of bounded size, and each query goes to every slice. A task holds one slice at a time and
reads the queries in batches after it, so neither all rows nor all queries have to fit into memory, and no slice is copied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers in one slice of vectors.
SLICE_NUMBERS = 16_000_000
#: Vectors of a slice and queries whose scores are held at a time.
VECTORS_AT_ONCE, QUERIES_AT_ONCE = 4096, 128


def usable(vector: Column) -> Column:
    """Whether a vector has components and all of them are finite numbers."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def slices_for(rows: DataFrame) -> int:
    """Slices for vectors ``_v``: each has about SLICE_NUMBERS numbers at most, and there is one for each core at least."""
    numbers = rows.agg(F.sum(F.size("_v").cast("long"))).first()[0] or 0
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-numbers // SLICE_NUMBERS))


def matrix(batch: pa.RecordBatch, column: str = "_v") -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def runs(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """Pieces of a batch with the same values in some integer columns."""
    keys = np.stack([batch.column(c).to_numpy() for c in columns], axis=1)
    edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield tuple(keys[a].tolist()), batch.slice(a, b - a)


def past_slices(rows: DataFrame, queries: DataFrame, slices: int, f: Callable[[pa.RecordBatch, pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """What ``f`` (a slice's rows in order of ``_id``, some queries) gives for each slice and all queries of its vectors' length.

    Both tables have ``_id``, ``_v`` and the same columns besides; ``_size`` is the length of vectors that are held in another form.
    """
    columns = [c for c in rows.columns if c in queries.columns and c != "_size"]
    size = lambda df: F.col("_size") if "_size" in df.columns else F.size("_v").alias("_size")
    own = rows.select(F.pmod(F.xxhash64("_id"), F.lit(slices)).cast("int").alias("_slice"), F.lit(0).alias("_kind"), size(rows), *columns)
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_slice"), F.lit(1).alias("_kind"), size(queries), *columns)
    dealt = own.unionByName(asked).repartition(slices, "_slice").sortWithinPartitions("_slice", "_size", "_kind", "_id")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held = None, [], None
        for batch in batches:
            for (part, size, kind), piece in runs(batch, ["_slice", "_size", "_kind"]):
                if (part, size) != at:
                    at, parts, held = (part, size), [], None
                if kind == 0:
                    parts.append(piece)
                elif parts or held is not None:
                    if held is None:
                        held, parts = pa.Table.from_batches(parts).combine_chunks().to_batches()[0], []
                    for a in range(0, piece.num_rows, QUERIES_AT_ONCE):
                        if (out := f(held, piece.slice(a, QUERIES_AT_ONCE))) is not None and out.num_rows:
                            yield out

    return dealt.mapInArrow(stream, schema)


def first_k(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k highest allowed scores of each row, ties to the left; in that order."""
    if scores.shape[1] > k:
        low = np.where(allowed, scores, np.iinfo(np.int64).min)
        kth = np.partition(low, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        allowed = allowed & (scores >= kth[:, None])
    x, y = np.nonzero(allowed)
    x, _, y = trimmed(x, scores[x, y], y, k)
    return x, y


def trimmed(x: np.ndarray, score: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each x by falling score, then rising y."""
    order = np.lexsort((y, -score, x))
    x, score, y = x[order], score[order], y[order]
    first = np.arange(len(x)) - np.searchsorted(x, x) < k
    return x[first], score[first], y[first]
