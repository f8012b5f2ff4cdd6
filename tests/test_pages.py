"""Batch and streaming reads of numbered pages."""

import json

from corpusmill.sources.pages import JsonPages


def write(folder, number, items):
    (folder / f"page-{number:04d}.json").write_text(json.dumps({"hits": {"total": 9, "hits": items}}))


def test_pages(spark, tmp_path):
    pages, out = tmp_path / "pages", tmp_path / "out"
    pages.mkdir()
    spark.dataSource.register(JsonPages)
    read = lambda: sorted((r.page, r.position, json.loads(r.item)) for r in spark.read.format("json_pages").option("pagesPerTask", 3).load(str(pages)).collect())
    assert read() == []
    rows = {n: [{"id": f"{n}-{i}", "t": "é" * i} for i in range(n % 4 + 1)] for n in range(1, 9)}
    for n in range(1, 6):
        write(pages, n, rows[n])
    (pages / "notes.txt").write_text("no page")
    flat = lambda last: sorted((n, i, x) for n in range(1, last + 1) for i, x in enumerate(rows[n]))
    assert read() == flat(5)

    def stream():
        s = spark.readStream.format("json_pages").option("pagesPerTask", 2).load(str(pages))
        s.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
        return sorted((r.page, r.position, json.loads(r.item)) for r in spark.read.parquet(str(out)).collect())

    assert stream() == flat(5)
    for n in (6, 7, 8):
        write(pages, n, rows[n])
    write(pages, 9, [])
    write(pages, 10, [{"id": "after the end"}])
    assert read() == flat(8) and stream() == flat(8) and stream() == flat(8)
