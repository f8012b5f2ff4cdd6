"""Staged searches: what they read, and rows at the edges."""

import datetime

from pyspark.sql import functions as F

from corpusmill.operators import search


def test_late_lexical_reads_few_long_texts(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(i, day + datetime.timedelta(days=i), f"title {i % 9}", "s") for i in range(500)], "id long, ts timestamp, title string, source string").write.parquet(str(tmp_path / "short"))
    spark.createDataFrame([(i, f"the long text has wörd{i % 5}") for i in range(500)], "id long, text string").write.parquet(str(tmp_path / "long"))
    short, long = spark.read.parquet(str(tmp_path / "short")), spark.read.parquet(str(tmp_path / "long"))
    queries = spark.createDataFrame([(1, "Wórd3 title 7"), (2, "zzz"), (3, ""), (4, None)], "q long, text string")
    out = search.late_lexical(short, "id", "ts", "source", F.col("title"), long, F.col("text"), queries, "q", "text", F.lit("2030-01-01").cast("timestamp"), limit=1)
    rows = out.orderBy("q", "rank").collect()
    assert {r.q for r in rows} == {1} and len(rows) == 8 and all(r.id >= 480 for r in rows)
    assert [(r.id, r.score) for r in rows[:3]] == [(493, 2.0), (498, 2.0), (490, 1.0)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "In(id, [" in plan
    assert "text" not in plan.split("short")[0].split("ReadSchema")[0]


def test_phrases(spark):
    docs = spark.createDataFrame([(1, "Red House"), (2, None), (3, "blue"), (3, "blue"), (4, "x")], "id long, own string")
    labels = spark.createDataFrame([(1, "car"), (2, "big car house"), (3, "car"), (3, None), (9, "car house")], "id long, label string")
    found = lambda phrases, **more: sorted(map(tuple, search.phrase_matches(docs, "id", labels, "label", phrases, **more).collect()))
    assert found(["car house", "blue car", "HOUSE"], own="own") == [("HOUSE", 1), ("HOUSE", 2), ("blue car", 3), ("car house", 1), ("car house", 2)]
    assert found(["car house"]) == [("car house", 2)]
    assert search.phrase_matches(docs.where("false"), "id", labels.where("false"), "label", ["a"], own="own").count() == 0


def test_like_id():
    assert [search.like_id(x) for x in ("E85862N25", "n25", "71381", "713", "12 34", "a1n2", "N", "1234x")] == [True, False, True, False, False, True, False, False]


def test_stage_that_is_not_needed(spark):
    docs = spark.createDataFrame([("A1N20", None, None, datetime.date(2020, 1, 1), "t", "s", "e")], "id string, number string, year int, date date, title string, summary string, state string")
    none = spark.createDataFrame([], "id string, vector array<double>")
    asked = spark.createDataFrame([], "request string, vector array<double>")
    out = search.staged_search([search.Request("r", "a1n20")], docs, none, asked)
    assert [(r.number, r.year, r.found_by, r.total) for r in out.collect()] == [("A1N20", 2020, "literal", 1)]
    assert "cosine" not in str(out._jdf.queryExecution().optimizedPlan()) and "vector" not in out._jdf.queryExecution().optimizedPlan().toString()
