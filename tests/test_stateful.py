"""Streams with state against the same operators on tables."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import quality
from corpusmill.streaming import stateful

START = datetime.datetime(2024, 1, 1)
SCHEMA = "k string, ts timestamp, n long, kind string"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Files of events in order of time, the last one far later so that all timers fire."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKSDB)
    r, folder = random.Random(4), str(tmp_path_factory.mktemp("events"))
    times = sorted(r.randrange(0, 6000) for _ in range(400))
    rows = [(r.choice("abc"), START + datetime.timedelta(seconds=t), i, r.choice(["used"] * 9 + ["exhausted"] * 4) if t < 5000 or i % 30 else "blocked") for i, t in enumerate(times)]
    rows.append(("z", START + datetime.timedelta(days=9), 999, "used"))
    for i in range(5):
        part = rows[i * 100 : (i + 1) * 100]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    yield folder
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, folder, tmp_path, f):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    out = str(tmp_path / "out")
    f(stream).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(200)
    return sorted(map(tuple, spark.read.parquet(out).collect()), key=str)


def test_spaced(spark, parts, tmp_path):
    got = streamed(spark, parts, tmp_path, lambda s: stateful.spaced(s, ["k"], "ts", "n", 120, "10 seconds"))
    want = quality.without_repeats(spark.read.parquet(parts), ["k"], "ts", "n", 120).collect()
    assert got == sorted(map(tuple, want), key=str) and len(got) > 50


def test_key_states(spark, parts, tmp_path):
    got = streamed(spark, parts, tmp_path, lambda s: stateful.key_states(s, "k", "ts", F.col("kind"), 60, "10 seconds"))
    want = stateful.key_transitions(spark.read.parquet(parts), "k", "ts", F.col("kind"), 60, F.lit(START + datetime.timedelta(days=9)))
    assert got == sorted(map(tuple, want.collect()), key=str)
    assert {r[2] for r in got} == {"resting", "active", "blocked"}


def test_repeats_over_spans(spark, monkeypatch):
    """Bursts that cross spans of time, keys without value and events at the same time."""
    r = random.Random(2)
    rows = [(r.choice(["a", None]), START + datetime.timedelta(seconds=r.randrange(0, 3000)), i, "x") for i in range(300)]
    want = []
    for key in ("a", None):
        last = None
        for k, ts, n, _ in sorted((x for x in rows if x[0] == key), key=lambda x: (x[1], x[2])):
            if last is None or (ts - last).total_seconds() >= 20:
                want.append((k, ts, n))
                last = ts
    df = spark.createDataFrame(rows, SCHEMA)
    for span in (1, 256):
        monkeypatch.setattr(quality, "SPAN", span)
        assert sorted(map(tuple, quality.without_repeats(df, ["k"], "ts", "n", 20).collect()), key=str) == sorted(want, key=str)
