"""The pipeline's stages on a small corpus, against what each operator says alone."""

import os
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm.mixing import source_targets
from corpusmill.llm.toxicity import toxicity_scores, train_on
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        if name == "line_dedup":
            assert sorted((r.doc_id, r.text or "") for r in out.collect()) == sorted(plain_lines(docs.select("doc_id", "source", "text").collect()))
        if name == "mixing":
            # each source's words come within half a document of its target, and no document is taken more than three times
            sizes = Counter()
            for r in out.collect():
                sizes[r.source] += len(brute.WORD.findall(r.text or ""))
            targets = {r._source: (r._target, r._source_size) for r in source_targets(docs.select(F.col("source").alias("_source"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("_size")), (1, 2, 3), 3).collect()}
            longest = max(len(brute.WORD.findall(r.text or "")) for r in docs.collect())
            assert all(abs(sizes[s] - t) <= longest / 2 + 1 for s, (t, _) in targets.items())
            assert max(Counter(r.doc_id for r in out.collect()).values()) <= 3
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity_scores(docs, train_on(docs, spark.read.parquet(f"{SF}/labels.parquet"))).where("predicted = 1").collect()}
            assert bad and {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - bad
        if name == "near_dedup":
            want = {d for d, (_, _, kept) in brute.near([(r.doc_id, r.text) for r in docs.collect()], width=5).items() if kept}
            assert {r.doc_id for r in out.select("doc_id").collect()} == want
        docs = out.cache()
        assert docs.where("n_chars <> length(text)").count() == 0
    tool = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    want = sorted((r.doc_id, [*tool.encode(r.text or ""), tool.eos_id()]) for r in docs.collect())
    assert sorted((r.doc_id, list(r.ids)) for r in last.collect()) == want


def plain_lines(rows):
    """(id, text) without the lines that over a twentieth of a source's different texts hold, and five at least."""
    texts, held = {}, {}
    for _, source, text in rows:
        texts.setdefault(source, set()).add(text or "")
    for source, own in texts.items():
        held[source] = Counter(x for t in own for x in {line.strip(" \t\r") for line in t.split("\n")} if x)
    often = {s: {x for x, n in c.items() if n >= 5 and n > 0.05 * len(texts[s])} for s, c in held.items()}
    return [(d, "\n".join(x for x in (t or "").split("\n") if x.strip(" \t\r") not in often[s])) for d, s, t in rows]


def test_odd_columns(spark, tmp_path):
    """Names with dots pass every stage, and without sources all documents are of one."""
    rows = [(i, f"text number {i} with a few words of its own {i * i}", "en", 9) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, `a.b` int")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and {r["a.b"] for r in out.collect()} == {9}, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 12


def test_empty_and_nulls(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "a b c d e f", "en", None, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.lit(1))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for d in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, d, str(tmp_path))
            assert out.columns == d.columns
            out.count()
        assert corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path)).count() == d.count()
