"""What the toxicity model learns from whole texts, and how well it does on the rows that it never saw."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import toxicity

SF = "/root/testdata/sf0.01"


def test_offence_deep_in_long_texts(spark):
    """The only offence stands beyond thousands of words; it is learnt and located all the same."""
    rows = [(i, "All is fine here. " * 1500 + ("You blorkish snerk. " if i % 4 == 0 else "") + "The end.", int(i % 4 == 0)) for i in range(80)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity_scores(docs, toxicity.train_on(docs, labels), worst=True).collect()}
    assert all(out[i].predicted == x for i, _, x in rows)
    assert out[0].worst == ["You blorkish snerk"] and out[1].worst == []


def test_bags_without_features_are_counted(spark):
    """A sentence without features pulls as much when counted as when it stands as an empty bag."""
    sample = spark.createDataFrame([(1, "Bad thing. Fine. Fine too.", 1), (2, "Fine.", 0), (3, None, 0)], "_id long, _text string, _label int")
    rows = toxicity.numbered(sample, ["wbad", "gthi"]).toPandas().sort_values("_id")
    assert [list(x) for x in rows["flat"]] == [[0, 1], [], []] and rows["bare"].tolist() == [2, 1, 0]
    w = toxicity.train(rows, 2)
    assert np.isfinite(w).all() and w[0] > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    scored = toxicity.toxicity_scores(docs, toxicity.train_on(docs, labels)).where(toxicity.held_out())
    rows = scored.join(labels, "doc_id").select("score", F.col("toxic").alias("t")).toPandas()
    a, b = rows[rows.t == 1].score.to_numpy(), rows[rows.t == 0].score.to_numpy()
    assert len(a) >= 3 and (a[:, None] > b[None, :]).mean() + 0.5 * (a[:, None] == b[None, :]).mean() > 0.85


def test_gradient_against_plain_loss():
    """The gradient equals differences of a loss written out document by document."""
    rng = np.random.default_rng(2)
    docs = [[[0, 1], [1]], [[2, 2, 0]], [], [[1, 2], [0], [2]]]
    bare, labels, decay = np.asarray([1.0, 0.0, 3.0, 2.0]), np.asarray([1, 0, 0, 1]), 0.3
    index = np.asarray([x for d in docs for s in d for x in s])
    sizes = np.asarray([len(s) for d in docs for s in d])
    many = np.asarray([len(d) for d in docs])

    def loss(w):
        chance = lambda z: 1 / (1 + np.exp(-z))
        total = 0.0
        for d, n, y in zip(docs, bare, labels):
            clean = (1 - chance(w[-1])) * (1 - chance(w[-2])) ** n
            for s in d:
                clean *= 1 - chance(sum(w[x] for x in s) + w[-2])
            total -= np.log(1 - clean if y else clean)
        return total / len(docs) + decay / 2 * (w[:-2] ** 2).sum()

    w = rng.normal(size=5)
    got = toxicity.gradient(w, index, sizes, many, bare, labels, decay)
    for i in range(len(w)):
        step = np.zeros(5)
        step[i] = 1e-6
        assert abs((loss(w + step) - loss(w - step)) / 2e-6 - got[i]) < 1e-7
