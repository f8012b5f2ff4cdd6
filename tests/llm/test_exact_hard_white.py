"""The digest index, hard negatives and whitening against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import exact_dedup, hard_negatives, slices, whitening

NAN, INF = float("nan"), float("inf")
TEXTS = [(1, "Same Text"), (2, "sAME tEXT"), (3, "same text "), (4, None), (5, ""), (6, "ÀB"), (7, "àb"), (8, "Àb"), (9, "x" * 300_000), (10, "X" * 300_000), (None, "same text"), (11, "\x00İ"), (12, "\x00İ"), (12, "\x00İ"), (None, "alone"), (13, "other")]


def plain_digest(text):
    return hashlib.sha256("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()).hexdigest()


def plain_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(plain_digest(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[d := plain_digest(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, d))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3).withColumn("_id", F.lit("x")).withColumn("keep_id", F.lit(1)).withColumn("digest", F.lit(2)).withColumn("a.b", F.lit(3))


@pytest.mark.parametrize("batches", [1, 3, 40])
def test_exact_dedup(docs, batches):
    assert found(exact_dedup.deduplicate(docs, batches=batches)) == plain_groups(TEXTS)
    assert exact_dedup.deduplicate(docs.where("false"), batches=batches).count() == 0


def test_exact_dedup_hot_groups(spark):
    """More groups than may be broadcast, and some with a third of all rows."""
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 2500}") for i in range(9000)]
    assert found(exact_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), batches=2)) == plain_groups(rows)


def test_digest_index_persists(spark, tmp_path):
    path = str(tmp_path / "index")
    first, later = [(1, "a"), (2, "A"), (3, "b")], [(9, "a"), (8, "c"), (7, "C")]
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    exact_dedup.deduplicate(df(first), exact_dedup.DigestIndex(spark, path, buckets=4)).collect()
    spark.sql(f"DROP TABLE {exact_dedup.DigestIndex(spark, path).name}")
    again = exact_dedup.DigestIndex(spark, path, buckets=99)
    assert again.buckets == 4 and again.entries().count() == 2
    for _ in range(2):  # a batch that is run again changes nothing
        out = exact_dedup.deduplicate(df(later), again)
        assert {r.doc_id: (r.keep_id, r.kept, r.group_size) for r in out.collect()} == {9: (2, False, 1), 8: (8, True, 2), 7: (8, False, 2)}
        assert again.entries().count() == 3
    wide = again.copied_to(str(tmp_path / "wide"), buckets=6)
    assert wide.buckets == 6 and sorted(map(tuple, wide.entries().collect())) == sorted(map(tuple, again.entries().collect()))
    joined = df(later).select(exact_dedup.digest(F.col("text")).alias("digest")).join(wide.entries().hint("merge"), "digest")
    plan = joined._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_residue_products():
    r = np.random.default_rng(5)
    for size, largest in ((1, 3), (64, 300), (200, 5000), (150, 2**24)):
        a, b = (r.integers(-largest, largest + 1, size=(7, size)) for _ in range(2))
        moduli = hard_negatives.moduli_for(a, b)
        got = hard_negatives.products(hard_negatives.residues(a, moduli), hard_negatives.residues(b, moduli), moduli)
        assert (got == a @ b.T).all()
    ends = np.full((1, 64), 510), np.full((1, 64), -510)
    moduli = hard_negatives.moduli_for(*ends)
    assert hard_negatives.products(hard_negatives.residues(ends[0], moduli), hard_negatives.residues(ends[1], moduli), moduli)[0, 0] == -64 * 510 * 510
    assert np.prod([float(p) for p in moduli]) > 2 * 64 * 510 * 510 and moduli == [1021, 1019, 1013]


def plain_negatives(rows, every, k=5):
    ints = [(i, y, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, y, v in rows if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, y, q in ints:
        if a % every:
            continue
        scored = sorted((-sum(s * t for s, t in zip(q, v)), i, x) for i, x, v in ints if i != a and len(v) == len(q))
        for p, i, _ in [s for s in scored if s[2] == y][:k]:
            for n, (s, j, _) in enumerate([s for s in scored if s[2] != y and 80 * -p <= 100 * -s[0] <= 100 * -p][:k]):
                out.append((a, i, n + 1, j, -p, -s))
    return sorted(out)


def test_hard_negatives(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, r.randrange(3), [r.choice((-1, 1, 1, 2)) * r.random() for _ in range(5)]) for i in range(300)]
    rows += [(300 + i, i % 2, [0.5, 0.5, 0.5, 0.5, 0.5]) for i in range(60)] + [(400, 1, [1.0, 2.0]), (401, 1, [1.0, 1.0]), (402, 0, [1.0, 0.9]), (403, None, [1.0] * 5), (404, 1, None), (405, 1, [NAN] * 5)]
    rows += [(406, 1, [1.0, None, 1.0, 1.0, 1.0]), (407, 1, []), (None, 1, [1.0] * 5), (408, 2, [INF] * 5), (500, 9, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(5).withColumn("_id", F.lit("x")).withColumn("rank", F.lit(0)).withColumn("_v", F.lit(1)).withColumn("a.b", F.lit(1))
    ask = lambda d: hard_negatives.hard_negatives(d, F.col("vec_id") % 20 == 0, F.col("label"))
    got = sorted(map(tuple, ask(df).collect()))
    assert got == plain_negatives(rows, 20) and len(got) > 200
    assert ask(df.where("false")).count() == 0
    assert ask(df.where("vec_id = 0")).count() == 0
    monkeypatch.setattr(slices, "SLICE_NUMBERS", 40)  # many slices
    assert sorted(map(tuple, ask(df).collect())) == got


def test_first_k():
    scores = np.asarray([[3, 5, 5, 1, 5], [0, 0, 0, 0, 0]])
    x, y = slices.first_k(scores, np.asarray([[True] * 5, [False, True, False, False, True]]), 2)
    assert (x.tolist(), y.tolist()) == ([0, 0, 1, 1], [1, 2, 1, 4])


def test_scatter():
    r = np.random.default_rng(1)
    for most in ([0, 1, 7, 100], [5, 0, 0, 2**40]):
        y = np.stack([r.integers(0, m + 1, size=1000) for m in most], axis=1)
        got = whitening.scatter(y, [int(v).bit_length() for v in y.max(axis=0)])
        assert (got == np.triu(y.T.astype(object) @ y.astype(object))).all()


def test_whitening(spark):
    r = np.random.default_rng(7)
    base = (r.normal(size=(500, 6)) @ r.normal(size=(6, 6)) / 4).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(0, base[0].tolist()), (None, base[1].tolist()), (900, None), (901, [NAN] * 6), (902, []), (903, [INF] * 6), (904, [None] * 6), (905, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4).withColumn("_v", F.lit(1)).withColumn("n", F.lit("n")).withColumn("a.b", F.lit(1))
    out = whitening.whiten(df, components=4).collect()
    x = np.floor(1024 * np.concatenate((base, base[:2])).astype(np.float64)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    covariance = np.cov(x.T, bias=True)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    plain = (x - total / n) @ vectors / np.sqrt(values)
    assert len(out) == 4 * n and {q.n for q in out} == {n} and {q.vec_id for q in out} == {None, *range(500)}
    for q in out:
        if q.vec_id is not None:
            c = q.component - 1
            assert abs(abs(q.whitened) - abs(plain[q.vec_id, c])) < 1e-8
            assert abs(q.explained / (values[c] / values.sum()) - 1) < 1e-9
            assert q.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[q.vec_id], total))
            assert q.identity_error < 1e-9
    few = whitening.whiten(df.where("vec_id IN (1, 2)"))
    assert sorted((q.vec_id, q.component, q.n) for q in few.collect()) == [(1, 1, 2), (2, 1, 2)]
    assert whitening.whiten(df.where("vec_id = 905")).count() == 0
    assert whitening.whiten(df.where("false")).count() == 0


def test_whitening_large_components(spark):
    rows = [(i, [1e30 * (i % 2), float(i)]) for i in range(10)]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(out) in (10, 20) and all(np.isfinite(q.whitened) for q in out)
