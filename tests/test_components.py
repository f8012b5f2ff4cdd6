"""Components by star contraction, and what a rewrite of terms leaves."""

import random

from corpusmill.operators import graph
from corpusmill.sources import tables


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in list(root)}


def test_components(spark, monkeypatch):
    r = random.Random(1)
    chain = list(range(1000))
    r.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(2000, 2000 + i) for i in range(1, 300)] + [(r.randrange(3000, 3200), r.randrange(3000, 3200)) for _ in range(90)] + [(5000, 5000)]
    written, keep = [], tables.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: written.append(1) or keep(df))
    got = {x.node: x.root for x in graph.components(spark.createDataFrame([*edges, (None, 1), *edges[:5]], "a long, b long"), "a", "b").collect()}
    assert got == plain(edges)
    # two tables a round: a chain of a thousand ends in a few rounds
    assert len(written) <= 2 * 14
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_rewritten_terms(spark):
    catalog = spark.createDataFrame([(1, "colour"), (2, "color."), (3, "COLOR"), (4, "shape"), (5, "shape "), (6, ""), (7, None)], "id long, term string")
    links = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 5), (3, 6), (3, 99), (3, 99)], "doc long, term_id long")
    pairs = spark.createDataFrame([("color", "colour")], "a string, b string")
    after, moved = graph.rewritten_terms(catalog, "id", "term", links, "doc", "term_id", pairs)
    assert sorted(map(tuple, after.collect()), key=str) == [(3, "Color."), (4, "Shape."), (6, ""), (7, None)]
    assert sorted(map(tuple, moved.collect())) == [(1, 3), (2, 3), (2, 4), (3, 6), (3, 99)]
