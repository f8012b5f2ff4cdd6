"""Connected components of an edge table, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id`` and ``component`` (smallest id reachable) of every node that has an edge to another.

    Large-star and small-star steps alternate until the edges are stars around their smallest node; each round is one
    grouping of the edges in each direction and its result is written, so a lost executor never goes back further.
    Stars keep their edge count; no step emits more rows than it reads.
    """
    edges = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = written(edges, "edges")
    while True:
        # large star: neighbours that are larger than a node go to the smallest of its neighbourhood
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the node itself go to the smallest of them
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = written(small.select("e.u", "e.v").where("u != v").distinct(), "edges")
        moved = after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty()
        edges = after
        if moved:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
