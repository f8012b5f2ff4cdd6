"""The approximation file: bounds that hold, few exact reads, and results that equal plain search under odd rows and names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import vector_search
from tests.llm import brute


@pytest.mark.parametrize("size", [1, 7, 64])
def test_bounds_hold(size):
    rng = np.random.default_rng(size)
    exact, q = rng.integers(-3000, 3000, (500, size)), rng.integers(-3000, 3000, (9, size))
    low, high = exact.min(axis=0), exact.max(axis=0)
    grid = {d: (int(low[d]), int(high[d] - low[d]) // vector_search.CELLS + 1) for d in range(size)}
    least, width = vector_search._grid(grid, size)
    lower, upper = vector_search.bounds(((exact - least) // width).astype(np.uint8), q, grid)
    score = q @ exact.T
    assert (lower <= score).all() and (score <= upper).all()


def test_few_exact_reads(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(3000, 32)).astype(np.float32))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    exact = vector_search.integer_vectors(vectors, "vec_id", "embedding").withColumn("_row", F.col("_id"))
    grid = vector_search.grid_of(exact)
    left = vector_search.candidates(vector_search.approximations(exact, grid), exact.where("_id % 100 = 0").select("_id", "_v"), grid, 10)
    many = left.groupBy("query_id").count().toPandas()["count"]
    assert len(many) == 30 and many.min() >= 10 and many.max() < 300
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vector_search.top_k(vectors, F.col("vec_id") % 100 == 0).collect())
    assert got == sorted(brute.top(rows))


def test_repeated_rows_and_clashing_names(spark):
    rows = [(i % 40, [float((i * 7 + j) % 11 - 5) for j in range(5)]) for i in range(120)]
    rows += [(100, [1.0, 2.0, 0.5, 0.25, 1.0])] * 3
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for name in ("_id", "_v", "_row", "_size", "score", "rank", "query_id", "ids", "cells"):
        vectors = vectors.withColumn(name, F.lit("x"))
    got = sorted((r["rank"], r.vec_id, r.score) for r in vector_search.top_k(vectors, F.col("vec_id") == 100).collect())
    q = [1024, 2048, 512, 256, 1024]
    want = sorted((-sum(a * int(1024 * b) for a, b in zip(q, v)), i) for i, v in rows if i != 100)[:10]
    assert got == [(n, i, -s) for n, (s, i) in enumerate(want, 1)]
