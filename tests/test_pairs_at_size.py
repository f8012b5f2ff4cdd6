"""Pairs of lines and of documents with lines, against plain versions; what meets is bounded before it is paired."""

import random

from pyspark.sql import functions as F

from corpusmill.operators import clusters, coherence, proposals


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_title_pairs_shuffle_no_pairs(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["One title", "one  title", "other"]), rng.sample("abcd", rng.randint(0, 3)), [None, *rng.sample("xyz", 1)][rng.randint(0, 1) :]) for k in range(60)] + [(60, None, ["a"], ["x"]), (61, "other", None, None)]
    df = spark.createDataFrame(rows, "k long, title string, tags array<string>, sources array<string>")
    out = clusters.same_title_pairs(df, "k", "title", {"tags": "tags", "sources": "sources"})
    # nothing is grouped or joined once lines are paired
    above = plan(out).split("Join")[0]
    assert "Aggregate" not in above and "Repartition" not in above
    share = lambda x, y: len({i for i in x if i} & {i for i in y if i}) / max(1, min(len(set(x)), len(set(y))))
    known = [(k, " ".join(t.lower().split()), a or [], b or []) for k, t, a, b in rows if t]
    want = [(x[0], y[0], share(x[2], y[2]), share(x[3], y[3])) for x in known for y in known if x[0] < y[0] and x[1] == y[1]]
    want = sorted((a, b, round(t, 4), round(s, 4)) for a, b, t, s in want if max(t, s) >= 0.4)
    assert sorted((r.a, r.b, round(r.tags, 4), round(r.sources, 4)) for r in out.collect()) == want


def test_title_pairs_are_dealt_over_tasks(spark, monkeypatch):
    rng = random.Random(4)
    tags = {k: sorted({rng.randrange(90) for _ in range(rng.randint(1, 40))}) for k in range(240)}
    sources = {k: [rng.choice("vwxyz")] for k in tags}
    df = spark.createDataFrame([(k, "one", tags[k], sources[k]) for k in tags], "k long, title string, tags array<int>, sources array<string>")
    share = lambda x, y: len({*x} & {*y}) / min(len(x), len(y))
    half_up = lambda x: int(x * 1e4 + 0.5) / 1e4
    want = {(a, b): (share(tags[a], tags[b]), share(sources[a], sources[b])) for a in tags for b in tags if a < b}
    want = {p: (half_up(t), half_up(s)) for p, (t, s) in want.items() if max(t, s) >= 0.4}
    assert len(want) > 4000
    monkeypatch.setattr(clusters, "CELL", 40, raising=False)
    for words, block, pairs in ((16, 1000, 1 << 24), (1, 1, 1000)):
        monkeypatch.setattr(clusters, "WORDS", words, raising=False)
        monkeypatch.setattr(clusters, "BLOCK", block)
        monkeypatch.setattr(clusters, "PAIRS", pairs, raising=False)
        out = clusters.same_title_pairs(df, "k", "title", {"tags": "tags", "sources": "sources"})
        found = out.withColumn("_p", F.spark_partition_id()).collect()
        assert {(r.a, r.b): (r.tags, r.sources) for r in found} == want and len(found) == len(want)
        # pairs of one title are not one task's, though their blocks are few bytes; sets of up to WORDS words meet as bits
        assert len({r._p for r in found}) >= 4
        assert ("array_intersect" in plan(out)) == (words == 1)


def test_actions_deal_merges_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(clusters, "CELL", 20, raising=False)
    many, rng = 120, random.Random(5)
    tags = {k: rng.sample("abcdefgh", 5) for k in range(many)}
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda k: read.add(1) or k, "long").asNondeterministic()
    lines = spark.createDataFrame([(k, 0.5, "develops", "one", tags[k], tags[k][:2]) for k in tags], "line long, density double, bucket string, title string, tags array<string>, sources array<string>")
    found = spark.createDataFrame([(0, "mixed", 0.3, 0.5, 0.4), (1, "fragmented", 0.1, 0.1, 0.7)], "line long, status string, outliers double, noise double, fragmentation double")
    members = spark.createDataFrame([(0, 1, 0.1), (1, 2, 0.9), (1, 3, 0.9)], "line long, k long, score double")
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, item string")
    out = coherence.actions(found, lines.withColumn("line", seen("line")), "line", "k", members, items, most=None).withColumn("_p", F.spark_partition_id()).collect()
    merges = [r for r in out if r.action == "merge" and r.other is not None]
    share = lambda a, b, n: len({*tags[a][:n]} & {*tags[b][:n]}) / n
    assert sorted((r.line, r.other) for r in merges) == [(a, b) for a in tags for b in tags if a < b and max(share(a, b, 5), share(a, b, 2)) >= 0.4]
    assert sorted((r.action, r.line, r.detail) for r in out if r.other is None) == [("merge", 0, many), ("normalise", 0, None), ("reassign", 0, 1), ("split", 1, 2)]
    # lines are computed once, and pairs of one title are not one task's
    assert read.value == many
    assert len({r._p for r in merges}) >= 4


def test_reassignments_meet_subsets(spark):
    rng = random.Random(2)
    items = [chr(97 + i) for i in range(18)]
    tags = {line: rng.sample(items, rng.choice([1, 2, 3, 5, 5, 9])) for line in range(40)}
    held = {k: rng.sample(items, rng.choice([1, 2, 4, 7, 15])) for k in range(80)} | {80: ["nowhere"]}
    docs = [(rng.randrange(40), k) for k in held]
    frame = lambda d, names: spark.createDataFrame([(k, i) for k, v in d.items() for i in v], names)
    out = coherence.reassignments(spark.createDataFrame(docs, "line long, k long"), "line", "k", frame(held, "k long, item string"), frame(tags, "line long, item string"))
    assert "_s#" in plan(out)
    best = {k: min((-len(set(held[k]) & set(tags[t])), t) for t in tags if t != own) for own, k in docs}
    assert sorted((r.k, -r.shared, r.target) for r in out.collect()) == sorted((k, n, t) for k, (n, t) in best.items() if n)


def test_parts_link_documents(spark):
    members = spark.createDataFrame([(1, k) for k in range(6)] + [(2, 1), (2, 9)], "line int, k int")
    items = spark.createDataFrame([(0, "a"), (1, "a"), (1, "b"), (2, "b"), (3, "c"), (4, None), (5, None)], "k int, item string")
    assert {r.line: (r.parts, r.largest) for r in coherence.parts(members, "line", "k", items).collect()} == {1: (4, 3), 2: (2, 1)}
    assert [r[0] for r in spark.range(1).select(F.size(coherence.subsets(F.array(*map(F.lit, "abcd")), 2))).collect()] == [10]


def test_proposals_shuffle_no_pairs(spark, monkeypatch):
    rng = random.Random(3)
    held = {k: {"descriptor": rng.sample("abcde", rng.randint(0, 4)), "word": rng.sample("fghijk", rng.randint(0, 5)), "norm": rng.sample("lmn", rng.randint(0, 2))} for k in range(50)}
    line = {k: rng.choice([1, 1, 2, 3]) for k in held}
    day = {k: rng.choice([None, "2020-01-01", "2020-01-02", "2020-01-03"]) for k in held}
    known = {(rng.randrange(50), rng.randrange(50)) for _ in range(300)}
    lines = spark.createDataFrame([(1, "in_review", 3, None), (2, "evolving", None, 7), (4, "evolving", 1, 2)], "line int, status string, anchor int, representative int")
    members = spark.createDataFrame([(line[k], k, day[k], k % 3 == 0) for k in held], "line int, k int, ts string, restrictive boolean")
    items = spark.createDataFrame([(k, kind, i) for k, v in held.items() for kind, x in v.items() for i in x], "k int, kind string, item string")
    edges = spark.createDataFrame([*known, (None, 1), (1, None)], "src int, dst int")
    share = lambda x, y: len({*x} & {*y}) / len({*x} | {*y}) if x and y else 0.0
    want = {}
    for a in held:
        for b in held:
            if line[a] != line[b] or line[a] == 3 or None in (day[a], day[b]) or (day[a], a) >= (day[b], b) or (b, a) in known:
                continue
            x, y = held[a], held[b]
            over, new = {k: share(x[k], y[k]) for k in x}, {k: len({*y[k]} - {*x[k]}) for k in x}
            delta, family = max(new["descriptor"], min(new["word"], 3)) + (b % 3 == 0), (3 if line[a] == 1 else 7) in (a, b)
            if any(over[k] >= least for k, least in proposals.LEAST.items()) and (delta or new["norm"] or family):
                want[b, a] = (*[round(over[k], 4) for k in over], delta, new["norm"], family, sorted({*x["descriptor"]} & {*y["descriptor"]})[:3])
    assert len(want) > 90
    for block in (2000, 4):
        monkeypatch.setattr(proposals, "BLOCK", block)
        out = proposals.missing_relations(lines, "line", members, "k", "ts", items, edges)
        # nothing is grouped or joined once documents are paired
        above, join = plan(out).split("Join", 1)
        assert "Aggregate" not in above and "_d#" in join.splitlines()[0]
        got = {(r.src, r.dst): (round(r.descriptor_overlap, 4), round(r.word_overlap, 4), round(r.norm_overlap, 4), r.semantic_delta, r.new_norms, r.same_family, r.shared) for r in out.collect()}
        assert got == want


def test_document_sets_hold_the_items(spark):
    rows = [(1, "Alpha beta  x", " Big  Thing", "n2"), (1, "Alpha gamma", "big thing", "n1"), (1, None, "", "n1"), (1, "y", None, None), (2, None, None, None), (3, "Delta", "Über", "n3")] + [(3, "delta", "two", f"n{i}") for i in range(9)]
    each = spark.createDataFrame(rows, "k int, t string, d string, n string")
    one = each.groupBy("k").agg(*[F.collect_list(c).alias(c) for c in "tdn"]).unionByName(spark.createDataFrame([(4, None, None, ["z"])], "k int, t array<string>, d array<string>, n array<string>"))
    items = proposals.document_items(each, "k", F.col("t"), each, "d", each, "n").collect()
    want = {(k, kind): sorted(r.item for r in items if (r.k, r.kind) == (k, kind)) for k in (1, 3) for kind in proposals.OVERLAP}
    got = {r.k: r for r in proposals.document_sets(one, "k", F.col("t"), F.col("d"), F.col("n")).collect()}
    assert {*got} == {1, 3, 4} and got[4].norm == ["z"]
    assert {(k, kind): list(got[k][kind]) for k in (1, 3) for kind in proposals.OVERLAP} == want
