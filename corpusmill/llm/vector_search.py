"""Exact top-k search by vector-approximation files.

Vectors are written twice: whole, and as an approximation file in which each component is one byte, its cell on a grid that
spans all vectors. The file is dealt into slices once; each task reads a slice and streams all queries past it. Bounds of the
inner products come from the cells alone, in integers; what can't be among a query's k best of its slice is left there.
Over all slices, the k-th best lower bound rules out more. Then exact vectors are read in the order of their upper bounds:
some first, and of the rest only those whose bound reaches the k-th best exact score by then, so that the result is certain.
Queries and vectors are tables throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import tidy, written
from corpusmill.llm.slices import VECTORS_AT_ONCE, matrix, past_slices

#: Cells in one slice of the approximation file.
SLICE_CELLS = 64_000_000
#: Cells of each dimension.
CELLS = 256
#: Exact vectors that a query reads at first, in multiples of k.
FIRST_READ = 2


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """``_id`` and ``_v``: floor(scale * x) of each component. Null ids, null or empty vectors and such with null or non-finite components go."""
    v = F.col(vector_col)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    good = vectors.where(F.col(id_col).isNotNull() & (F.size(v) > 0) & F.forall(v, finite))
    return good.select(F.col(id_col).cast("long").alias("_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("_v"))


def _by_size(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows of at most VECTORS_AT_ONCE vectors of one length, with the matrix of these."""
    for pdf in batches:
        for _, group in pdf.groupby(pdf["_v"].map(len)):
            for a in range(0, len(group), VECTORS_AT_ONCE):
                part = group.iloc[a : a + VECTORS_AT_ONCE]
                yield part, np.stack(part["_v"].to_list())


def grid_of(exact: DataFrame) -> dict[int, tuple[int, int]]:
    """By dimension, the least component and the width of a cell: two numbers for each dimension."""

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, m in _by_size(batches):
            yield pd.DataFrame({"d": np.arange(m.shape[1], dtype=np.int32), "lo": m.min(axis=0), "hi": m.max(axis=0)})

    span = exact.select("_v").mapInPandas(tidy(ranges), "d int, lo long, hi long").groupBy("d").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return {r["d"]: (r["lo"], (r["hi"] - r["lo"]) // CELLS + 1) for r in span.collect()}


def _grid(grid: dict[int, tuple[int, int]], size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray([grid[d][0] for d in range(size)], dtype=np.int64), np.asarray([grid[d][1] for d in range(size)], dtype=np.int64)


def approximations(exact: DataFrame, grid: dict[int, tuple[int, int]]) -> DataFrame:
    """The approximation file: ``_id``, ``_row``, ``_size`` (dimensions) and ``_cells``, a byte for each component."""

    def quantised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, m in _by_size(batches):
            least, width = _grid(grid, m.shape[1])
            cells = ((m - least) // width).astype(np.uint8)
            yield part[["_id", "_row"]].assign(_size=m.shape[1], _cells=[c.tobytes() for c in cells])

    return exact.mapInPandas(tidy(quantised), "_id long, _row long, _size int, _cells binary")


def bounds(cells: np.ndarray, q: np.ndarray, grid: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of some integer queries with the vectors of some cells, by rows of queries.

    The product with the cells is of short floats, and what their rounding can add up to widens the bounds.
    """
    least, width = _grid(grid, cells.shape[1])
    whole = q.astype(np.float64)
    steps = whole * width
    reach = np.abs(steps).sum(axis=1) * (CELLS - 1)
    kind = np.float32 if reach.max(initial=0) < 1e37 else np.float64
    base = (steps.astype(kind) @ cells.T.astype(kind)).astype(np.float64) + (whole @ least)[:, None]
    slack = reach * (cells.shape[1] + 4) * float(np.finfo(kind).eps) + np.abs(whole) @ np.abs(least) * 1e-12
    spread = width - 1
    return base + (np.minimum(whole, 0) @ spread - slack)[:, None], base + (np.maximum(whole, 0) @ spread + slack)[:, None]


def _scan(grid: dict[int, tuple[int, int]], k: int):
    """Of some queries, the vectors of a slice whose upper bound reaches the k-th best lower bound there."""

    def scan(file: pa.RecordBatch, asked: pa.RecordBatch) -> pa.RecordBatch:
        q, names = matrix(asked), asked.column("_id").to_numpy()
        ids, rows = file.column("_id").to_numpy(), file.column("_row").to_numpy()
        cells = np.frombuffer(b"".join(file.column("_cells").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
        best, sure, held = np.full((len(names), k), -np.inf), np.full(len(names), -np.inf), []
        for v in range(0, len(ids), VECTORS_AT_ONCE):
            lower, upper = bounds(cells[v : v + VECTORS_AT_ONCE], q, grid)
            own = names[:, None] == ids[None, v : v + VECTORS_AT_ONCE]
            lower[own] = upper[own] = -np.inf
            both = np.concatenate((best, lower), axis=1)
            best = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            sure = best.min(axis=1)
            x, y = np.nonzero((upper >= sure[:, None]) & ~own)
            held.append((x, ids[v + y], rows[v + y], lower[x, y], upper[x, y]))
        x, found, row, low, high = (np.concatenate(c) for c in zip(*held))
        keep = high >= sure[x]
        return pa.RecordBatch.from_pydict({"query_id": names[x][keep], "vec_id": found[keep], "_row": row[keep], "lower": low[keep], "upper": high[keep]})

    return scan


def candidates(file: DataFrame, queries: DataFrame, grid: dict[int, tuple[int, int]], k: int) -> DataFrame:
    """query_id, vec_id, _row, upper and place (1: highest upper bound) of what the approximation file can't rule out."""
    cells = file.agg(F.sum(F.col("_size").cast("long"))).first()[0] or 0
    slices = max(file.sparkSession.sparkContext.defaultParallelism, -(-cells // SLICE_CELLS))
    vectors = file.select("_id", "_row", "_size", "_cells", F.lit(None).cast("array<long>").alias("_v"))
    asked = queries.select("_id", F.lit(None).cast("long").alias("_row"), F.size("_v").alias("_size"), F.lit(None).cast("binary").alias("_cells"), "_v")
    met = past_slices(vectors, asked, slices, _scan(grid, k), "query_id long, vec_id long, _row long, lower double, upper double")
    met = written(met, "bounds")
    by_lower = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lower")))
    sure = met.withColumn("_n", by_lower).where(F.col("_n") == k).select("query_id", F.col("lower").alias("_sure"))
    left_over = met.join(sure, "query_id", "left").where(F.col("_sure").isNull() | (F.col("upper") >= F.col("_sure")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("upper"), "vec_id", "_row"))
    return left_over.select("query_id", "vec_id", "_row", "upper", place.alias("place"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best other rows of each query row, by inner product of integer vectors.

    Ties go to the smaller id; a query with fewer other rows gets all. Only vectors of the query's length are compared.
    Queries of the same id count as one (the smallest vector), and rows of a query's own id are never its results; repeated
    rows each are a result. Components are exact up to 2**31 in size (scores up to 2**63). Other columns of ``vectors``,
    whatever their names, are left out.
    """
    whole = integer_vectors(vectors, id_col, vector_col, scale)
    # rows have a number of their own once they are written
    exact = written(whole.withColumn("_row", F.monotonically_increasing_id()), "exact")
    queries = written(integer_vectors(vectors.where(is_query), id_col, vector_col, scale).groupBy("_id").agg(F.min("_v").alias("_v")), "queries")
    grid = grid_of(exact)
    left = written(candidates(written(approximations(exact, grid), "approximations"), queries, grid, k), "candidates")

    def scored(rows: DataFrame) -> DataFrame:
        """Candidates with their exact score."""
        read = rows.join(exact.select("_row", "_v"), "_row").join(queries.select(F.col("_id").alias("query_id"), F.col("_v").alias("_q")), "query_id")
        return read.select("query_id", "vec_id", "_row", F.aggregate(F.zip_with("_q", "_v", lambda x, y: x * y), F.lit(0).cast("long"), lambda total, x: total + x).alias("score"))

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "_row")
    first = written(scored(left.where(F.col("place") <= FIRST_READ * k)), "first")
    kth = first.withColumn("_n", F.row_number().over(best)).where(F.col("_n") == k).select("query_id", F.col("score").alias("_kth"))
    rest = left.where(F.col("place") > FIRST_READ * k).join(kth, "query_id").where(F.col("upper") >= F.col("_kth"))
    found = first.unionByName(scored(rest.select("query_id", "vec_id", "_row")))
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
