"""Contexts and messages at the edges."""

import json

from pyspark.sql import functions as F

from corpusmill.operators import incidents


def test_sanitized(spark):
    deep = "[" * 50 + '{"token": [1, {"x": 2}], "ok": "sk-12345678 and Bearer a.b", "n": null}' + "]" * 50
    rows = [(deep,), (None,), ("",), ('"password: hidden, shown"',), ("3",), ("{bad token=x; y",), ("[" * 100_000,)]
    got = [r.c for r in spark.createDataFrame(rows, "c string").coalesce(1).select(incidents.sanitized(F.col("c")).alias("c")).collect()]
    assert json.loads(got[0].strip("[]")) == {"token": "[REDACTED]", "ok": "[REDACTED] and [REDACTED]", "n": None}
    assert got[1:6] == [None, "", '"[REDACTED], shown"', "3", "{bad [REDACTED]; y"] and got[6] == "[" * 100_000


def test_normalised(spark):
    rows = [(None, None), ("fetch failed: 302 then status 500", "c"), ("NO SUCH TABLE:  t1", '{"cookie": 1}'), ("internal error", None), ("status 99", None), ("fetch failed", None)]
    df = spark.createDataFrame(rows, "m string, context string").coalesce(1)
    out = incidents.normalised(df, "m", F.lit("s"), F.lit(None).cast("string"), context="context").collect()
    assert [r.code for r in out] == ["UNKNOWN", "NETWORK_FETCH_FAILED", "D1_NO_SUCH_TABLE", "UNKNOWN", "UNKNOWN", "NETWORK_FETCH_FAILED"]
    assert out[2].named == "t1" and out[2].context == '{"cookie":"[REDACTED]"}' and len({r.fingerprint for r in out}) == 3
