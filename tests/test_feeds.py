"""JSON objects from files of any layout, at several sizes of ranges."""

import json

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import feeds

ROWS = [{"id": f"E{i}", "text": '} "{ \\' * (i % 4) + "é\n" * (i % 7) + "x" * (i * 37 % 900), "in": {"a": [{"b": i}, {}], "s": "}{"}} for i in range(200)]
LAYOUTS = {
    "pretty": "[\n" + ",\n".join("  " + json.dumps(r, indent=2, ensure_ascii=False).replace("\n", "\n  ") for r in ROWS) + ",\n]\n",
    "line": "".join(json.dumps(r) for r in ROWS),
    "commas": "".join(json.dumps(r, ensure_ascii=False) + ",\r\n" for r in ROWS),
    "braces": "}} " + " } ".join(json.dumps(r) for r in ROWS) + '\n"a { string" {"id": "cut off", "text": "',
    "cut": "﻿" + "\n".join(json.dumps(r, indent=1) for r in ROWS) + '\n{"id": "one brace is missing"',
}


@pytest.mark.parametrize(("layout", "size"), [*((name, 701) for name in sorted(LAYOUTS)), ("line", 4099), ("cut", 1 << 27)])
def test_json_objects(spark, tmp_path, layout, size):
    for part in range(2):
        (tmp_path / f"{part}.txt").write_text(LAYOUTS[layout], encoding="utf-8", newline="")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        found = feeds.json_objects(spark, str(tmp_path)).orderBy("path", "start", "n").collect()
        assert [json.loads(r.json) for r in found] == ROWS * 2
        assert len({r.start for r in found}) > 3
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_feed(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1", "v": 1}, {"raw_data": {"doc_id": "2", "v": 2}}, {"v": 3}, {"id": "4", bad}, {"id": "5", "raw_data": {"v": 5}}]')
    rows, errors = feeds.feed(feeds.json_objects(spark, str(tmp_path)))
    assert sorted((r.id, json.loads(r.raw_data)["v"]) for r in rows.collect()) == [("1", 1), ("2", 2), ("5", 5)]
    assert [(r.id, r.json) for r in errors.collect()] == [("4", '{"id": "4", bad}')]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "b.json").write_text("")
    assert feeds.json_objects(spark, str(tmp_path / "none")).count() == 0
