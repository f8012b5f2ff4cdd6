"""Remedies on small tables: nulls, empty inputs, branches that the test tables don't reach."""

import datetime as dt

from pyspark.sql import functions as F

from corpusmill.operators import remedies


def test_labels_with_null_and_some_kinds(spark):
    df = spark.createDataFrame([(1, ["a_b ", "A  b", "c"]), (2, ["x", None]), (3, []), (4, None)], "k int, l array<string>")
    out = {r["k"]: r["x"] for r in df.select("k", remedies.normal_labels(F.col("l")).alias("x")).collect()}
    assert out[1]["labels"] == ["a b", "c"] and out[1]["applied"] == remedies.KINDS and not out[1]["empty"]
    assert out[2]["labels"] == ["x", ""] and out[2]["empty"] and out[2]["applied"] == []
    assert out[3]["labels"] == [] and not out[3]["empty"]
    few = df.where("k = 1").select(remedies.normal_labels(F.col("l"), ["collapse_whitespace"]).alias("x")).first()["x"]
    assert few["labels"] == ["a_b", "A b", "c"] and few["applied"] == ["collapse_whitespace"]


def test_swap_tells_missing_rows_and_keeps_the_limit(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    changes = spark.createDataFrame([(1, "a", "A"), (2, "x", "B"), (3, None, "C"), (9, "z", "Z"), (10, "q", "q")], "k int, seen string, new string")
    new, outcome = remedies.swapped(table, changes, "k", "v", 10)
    assert sorted(map(tuple, new.collect())) == [(1, "A"), (2, "b"), (3, "C")]
    assert sorted(map(tuple, outcome.collect())) == [(1, "applied"), (2, "conflict"), (3, "applied"), (9, "missing")]
    assert sorted(map(tuple, remedies.swapped(table, changes, "k", "v", 1)[0].where("k < 3").collect())) == [(1, "A"), (2, "b")]


def test_key_pool_waits_or_gives_none(spark):
    now = dt.datetime(2024, 1, 1, 12, 0, 30)
    rows = [("p", 1, "exhausted", now + dt.timedelta(hours=1), None), ("p", 2, "active", None, now), ("q", 3, "blocked", None, None), ("r", 4, "exhausted", now - dt.timedelta(hours=1), now), ("r", 5, None, None, None)]
    pool = spark.createDataFrame(rows, "pool string, k int, status string, exhausted_until timestamp, last_used timestamp")
    uses = spark.createDataFrame([(2, now), (2, now)], "k int, ts timestamp")
    got = {r["pool"]: (r["chosen"], r["retry_after"]) for r in remedies.chosen_keys(pool, "pool", "k", uses, 2, F.lit(now)).collect()}
    assert got == {"p": (None, 30), "q": (None, None), "r": (5, None)}
    failed = remedies.failed_keys(pool, spark.createDataFrame([(2, "quota"), (4, "error")], "k int, reason string"), "k", F.lit(now))
    state = {r["k"]: (r["status"], r["exhausted_until"]) for r in failed.collect()}
    assert state[2] == ("exhausted", now + dt.timedelta(hours=12)) and state[4] == ("active", None) and state[3] == ("blocked", None)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "line string, id int, role string, place int, weight int, priority int, date date")
    assert remedies.key_documents(docs, "line", "id").count() == 0
    noise = remedies.format_noise(spark.createDataFrame([], "k int, t string"), "k", "t", {"tab": "\t"}).collect()
    assert [(r["sign"], r["n"], r["ids"]) for r in noise] == [("tab", 0, [])]
