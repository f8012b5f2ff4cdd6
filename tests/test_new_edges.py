"""Empty tables, nulls and ties in the operators on lines, relations, older loads and alignment."""

import datetime

from pyspark.sql import functions as F

from corpusmill.operators import alignment, coherence, legacy, proposals, scoring

DAY = datetime.date(2020, 1, 1)


def test_missing_relations(spark):
    lines = spark.createDataFrame([(1, "in_review", 10, None), (2, "evolving", None, None)], "line int, status string, anchor int, representative int")
    members = spark.createDataFrame([(1, 10, DAY, False), (1, 11, DAY, True), (1, 12, None, False), (2, 10, DAY, False), (2, 13, DAY, False)], "line int, k int, ts date, restrictive boolean")
    items = spark.createDataFrame([(10, "descriptor", "a"), (11, "descriptor", "a"), (11, "norm", "n"), (12, "descriptor", "a"), (13, "word", "w")], "k int, kind string, item string")
    none = spark.createDataFrame([], "src int, dst int")
    out = proposals.missing_relations(lines, "line", members, "k", "ts", items, none).collect()
    # at the same time the smaller key comes first; a document without time and one that shares nothing have no pair
    assert [(r.line, r.src, r.dst, r.kind, r.confidence, r.semantic_delta, r.new_norms, r.shared) for r in out] == [(1, 11, 10, "partly_reconsidered", 0.78, 1, 1, ["a"])]
    known = spark.createDataFrame([(11, 10)], "src int, dst int")
    assert proposals.missing_relations(lines, "line", members, "k", "ts", items, known).count() == 0
    assert proposals.missing_relations(lines.where("false"), "line", members.where("false"), "k", "ts", items.where("false"), none, most=5).count() == 0
    texts = spark.createDataFrame([("Excepto que",), ("nada",), (None,)], "t string")
    assert [r[0] for r in texts.select(proposals.restrictive(F.col("t"))).collect()] == [True, False, False]


def test_coherence(spark):
    lines = spark.createDataFrame([(1, 0.9, "adjusts", "Same title", ["a"], ["s"]), (2, 0.1, "develops", "same  title", ["a"], ["s"]), (3, 0.5, "develops", "none", [], [])], "line int, density double, bucket string, title string, tags array<string>, sources array<string>")
    members = spark.createDataFrame([(1, 1, 0.1, 0), (1, 2, 0.9, 1), (2, 3, 0.3, 0), (2, 4, None, 0)], "line int, k int, score double, relations int")
    mentions = spark.createDataFrame([(1, 1, "a", "s"), (1, 2, "b", "s"), (2, 3, "a", None)], "line int, k int, tag string, source string")
    found = {r.line: r for r in coherence.signals(lines, "line", members, mentions, "tag", mentions, "source").collect()}
    assert set(found) == {1, 2} and found[1].outliers == 0.5 and found[2].outliers == 0.5 and found[1].members == 2
    items = mentions.select("k", F.col("tag").alias("item"))
    signals = coherence.signals(lines, "line", members, mentions, "tag", mentions, "source")
    acts = coherence.actions(signals, lines, "line", "k", members, items, most=None).collect()
    merges = [(r.line, r.other, r.detail) for r in acts if r.action == "merge"]
    assert (1, 2, None) in merges
    # the outlier of line 1 has an item of line 2
    assert [(r.line, r.detail) for r in acts if r.action == "reassign"] == [(1, 1), (2, 1)]
    parts = {r.line: (r.parts, r.largest) for r in coherence.parts(members, "line", "k", items).collect()}
    assert parts == {1: (2, 1), 2: (2, 1)}
    empty = lambda df: df.where("false")
    gone = coherence.signals(empty(lines), "line", empty(members), empty(mentions), "tag", empty(mentions), "source")
    assert gone.count() == 0 and coherence.findings(gone, "line").count() == 0
    assert coherence.actions(gone, empty(lines), "line", "k", empty(members), empty(items)).count() == 0


def test_legacy(spark):
    rows = spark.createDataFrame([(None, None, None), (" ley ", None, "2004.0"), ("x", "1.2", "20x.0"), ("DFL", "abc", "")], "kind string, number string, year string")
    out = [tuple(r) for r in legacy.canonical_sources(rows, "kind", "number", "year").collect()]
    assert out == [(None, None, None), ("Ley", None, "2004"), ("x", "1.2", "20"), ("DFL", "abc", "")]
    docs = spark.createDataFrame([(1, "5", 1999, "aplica N° 5 de 1999; ACLARÓ, Reactívase el N°5, de 1999"), (2, None, None, None), (3, "7", 1999, "altera N° ... de 1999")], "k int, number string, year int, text string")
    edges, flags = legacy.historical_relations(docs, "k", "text", "number", "year")
    assert sorted(map(tuple, edges.collect())) == [(1, 1, "applied"), (1, 1, "reactivated")] and [tuple(r) for r in flags.collect()] == [(1, ["applied", "reactivated"])]
    tags = spark.createDataFrame([(1, "A1.")], "k int, tag string")
    lists = spark.createDataFrame([(1, '["a1", "a1..", "b"]'), (2, None), (3, "[2]"), (4, "[null]")], "k int, j string")
    assert sorted(map(tuple, legacy.recovered_tags(lists, "k", "j", tags, "tag").collect())) == [(1, "A1."), (3, "2.")]


def test_alignment(spark):
    none = F.lit(None).cast("struct<label:string,terms:array<string>,confidence:double>")
    rows = spark.createDataFrame([(None, "a query here"), ("", "x"), ("a query here", None), ("query", "")], "t string, q string")
    got = [r.a.score for r in rows.select(alignment.alignment(F.col("t"), F.col("q"), F.lit(None).cast("double"), none, none).alias("a")).collect()]
    assert got == [0.0, 0.0, 0.0, 0.0]
    hits = spark.createDataFrame([(1, 5, 0.0), (1, 4, 0.0), (2, 1, None)], "q int, k int, s double")
    out = {r.q: (r.k, r.strong) for r in alignment.direct_choice(hits, "q", "k", "s", F.lit("x"), F.lit("yyy"), F.lit(None).cast("double")).collect()}
    assert out[1] == (4, False) and out[2][0] == 1
    ranked = scoring.dominant_rows(spark.createDataFrame([(1, " "), (2, None), (3, "b"), (4, "a")], "k int, label string"), "label", "k", "k", 9)
    assert sorted(r.k for r in ranked.collect()) == [1, 2]
