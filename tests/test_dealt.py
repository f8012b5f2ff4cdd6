"""Rows are dealt into more partitions than the session has where there are more of them, with the same results."""

import random
import re

from pyspark.sql import functions as F

from corpusmill.operators import aggregates, clusters, graph
from corpusmill.sources.tables import dealt


def exchanges(df):
    """Partitions of the shuffles of a plan."""
    text = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    return [int(n) for n in re.findall(r"Exchange hashpartitioning\(.*, (\d+)\)", text)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_only_more_partitions_are_dealt(spark):
    df = spark.range(100)
    assert dealt(df, None, "id") is df and dealt(df, 8, "id") is df
    assert dealt(df, 9, "id").rdd.getNumPartitions() == 9 and dealt(df, 9, "id").count() == 100


def wide(spark, run):
    """What ``run`` gives without and with 19 parts; joins are shuffled, and with parts no shuffle of rows has fewer."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain, many = run(None), run(19)
        return rows(plain), rows(many), exchanges(many)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_centrality_is_dealt(spark):
    members = spark.createDataFrame([(i % 3, i) for i in range(30)] + [(0, 0), (None, 5), (1, None)], "c int, k int")
    cited = spark.createDataFrame([(i % 40, i % 7) for i in range(200)] + [(3, None), (None, 1)], "k int, s int")
    plain, many, parts = wide(spark, lambda n: clusters.source_centrality(members, "c", "k", cited, "s", n))
    want = {}
    for c, k in {(c, k) for c, k in [(i % 3, i) for i in range(30)]}:
        for s in {s for x, s in [(i % 40, i % 7) for i in range(200)] + [(3, None)] if x == k}:
            want[c, s] = want.get((c, s), 0) + 1
    assert plain == many == sorted([(c, s, n, int(n / 10 * 100 + 0.5) / 100) for (c, s), n in want.items()], key=str)
    assert parts.count(19) >= 4 and set(parts) <= {8, 19}


def test_heatmap_is_dealt(spark):
    mentions = spark.createDataFrame([(i % 20, i % 6, f"{2000 + i % 20 % 3}-01-01") for i in range(150)], "d int, s int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    labels = spark.createDataFrame([(i, "xyz"[i % 3]) for i in range(6)], "s int, label string")
    plain, many, parts = wide(spark, lambda n: aggregates.mention_heatmap(dealt(mentions, n, "d"), "d", "s", "ts", labels, ["label"], 50, n))
    assert plain == many and sum(r[2] for r in many) == 150
    # documents and sources are dealt, and labels to meet them
    assert parts.count(19) == 3


def test_community_is_dealt(spark):
    edges = spark.createDataFrame([(i % 9, i % 5, "x") for i in range(60)] + [(4, 1, "x"), (None, 2, "x"), (2, None, "x")], "src int, dst int, action string")
    seeds = spark.createDataFrame([(i,) for i in (1, 2, 3, 3, 8, 11)], "k int")
    plain, many, parts = wide(spark, lambda n: graph.communities(edges, seeds, "k", n))
    assert plain == many and len({r[:2] for r in many}) == len(many) and (11, 11, "seed") in many
    assert parts and set(parts) == {19}


def test_influence_and_cores_join_nothing(spark):
    rng = random.Random(4)
    some = lambda x, n: None if rng.random() < 0.1 else [rng.choice([*x, None]) for _ in range(rng.randint(0, n))]
    rows = [(None if i == 0 else i % 5, i, some("abcd", 4), some("xy", 2), some(range(6), 5), f"20{rng.randint(10, 12)}-01-01" if rng.random() < 0.8 else None, i % 2, i % 4, 1, 1, i % 3, i % 2, 0, None, rng.random() * 1.2, 0.0) for i in range(60)]
    names = "c int, k int, tags array<string>, flags array<string>, sources array<int>, ts string, neighbour int, relations long, in_strengthens long, in_develops long, in_adjusts long, in_limits long, in_displaces long, latest_in string, align double, update double"
    members = spark.createDataFrame(rows, names).withColumns({x: F.col(x).cast("timestamp") for x in ("ts", "latest_in")})
    plain, many, parts = wide(spark, lambda n: clusters.influence(members, "c", "k", n).withColumn("priority", F.round("priority", 9)).withColumn("score", F.round("score", 9)))
    assert plain == many and parts == [19]
    scored = clusters.influence(members, "c", "k")
    named = lambda x: {i for i in x or [] if i is not None}
    held = {r[1]: (r[0], *map(named, r[2:5])) for r in rows[1:]}
    size = {c: sum(h[0] == c for h in held.values()) for c in range(5)}
    got = {r.k: r for r in scored.collect()}
    assert {*got} == {*held}
    for k, h in held.items():
        mates = [x for y, x in held.items() if y != k and x[0] == h[0]]
        for at, (kind, times) in enumerate((("tags", 2), ("flags", 2), ("sources", 1)), 1):
            assert abs(got[k][f"{kind}_part"] - min(1, sum(len(h[at] & x[at]) for x in mates) / max(1, (size[h[0]] - 1) * times))) < 1e-9
        assert got[k].top_source == (max(1 + sum(s in x[3] for x in mates) for s in h[3]) if h[3] else None)
    out = clusters.cores(scored, "c", "k")
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    for r in out.collect():
        own = sorted((x for x in got.values() if x.c == r.c), key=lambda x: (-x.priority, -x.score, x.k))
        density, top = sum(x.score for x in own) / len(own), own[0].priority
        able = [x for x in own if x.priority >= max(density, top * 0.78) and x.relations_part >= 0.34 and x.sources_part >= 0.25 and x.temporal_part >= 0.2 and x.obsolete_part < 0.8]
        assert (r.members, r.influential, r.representative, r.core) == (len(own), [x.k for x in own[:3]], own[0].k, min(2, len(able))) and abs(r.density - density) < 0.001
