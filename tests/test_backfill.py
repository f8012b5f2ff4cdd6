"""Windows of a back-fill: what a stopped run, a dry run and a lost job leave."""

from pyspark.sql import functions as F

from corpusmill.operators import backfill


def test_windows(spark, tmp_path):
    path = str(tmp_path / "target")
    rows = spark.createDataFrame([(i, "bad" if i in (25, 26) else f"t{i % 4}") for i in range(1, 41)] + [(None, "t9")], "id long, tag string")
    verdict = F.when(F.col("tag") == "bad", "filler").otherwise("accepted")

    def run(limit, **more):
        return backfill.run_windows(rows, "id", path, 10, verdict, lambda r: r.select("tag"), ["tag"], [backfill.count_over("filler", limit)], ["accepted", "filler"], **more).orderBy("step").collect()

    tags = lambda: sorted(r.tag for r in backfill.published(spark, path, "tag string").collect())
    assert tags() == []
    assert [r.status for r in run(0, apply=False)] == ["dry_run", "dry_run", "blocked"] and tags() == []
    assert [(r.start_key, r.status) for r in run(0, windows=1)][3:] == [(1, "applied")] and tags() == ["t0", "t1", "t2", "t3"]
    # a folder that no ledger row names is nothing
    spark.createDataFrame([("lost",)], "tag string").write.parquet(f"{path}/windows/lost")
    found = run(0)
    assert [(r.start_key, r.status, r.reason) for r in found][4:] == [(11, "applied", None), (21, "blocked", "filler_over_0")]
    assert found[5].metrics == {"read": 10, "accepted": 8, "filler": 2, "new": 0}
    assert [(r.start_key, r.status) for r in run(2)][6:] == [(21, "applied"), (31, "applied")]
    assert len(run(2)) == 8 and tags() == ["t0", "t1", "t2", "t3"]
    empty = backfill.run_windows(rows.where("false"), "id", str(tmp_path / "none"), 10, verdict, lambda r: r.select("tag"), ["tag"], [], ["accepted"])
    assert empty.count() == 0
