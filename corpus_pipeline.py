"""A training corpus from raw documents: toxicity, boilerplate lines, near duplicates, source mix, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; all but the last return the
columns of ``docs``. A stage only lets go of rows that its operator rejects: toxic documents, all but one document of each
group of near duplicates, and documents that the mix doesn't take. Lines of boilerplate are cut out of texts, and the mix
repeats the documents that it takes more than once. Null texts pass; a missing ``n_chars`` column stays missing, without
``source`` all documents are of one source, and columns of any name pass through. An empty table stays empty, and repeated
rows stay repeated.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import written
from corpusmill.llm.line_dedup import drop_boilerplate
from corpusmill.llm.minhash_dedup import near_duplicates
from corpusmill.llm.mixing import mix
from corpusmill.llm.sentencepiece_codec import encode_texts
from corpusmill.llm.toxicity import toxicity_scores, train_on


def _all(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _source(docs: DataFrame) -> Column:
    return F.col("source") if "source" in docs.columns else F.lit(None).cast("string")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; learned from the label table and the documents at hand."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.select(F.struct(*_all(docs)).alias("document"), "text")
    return toxicity_scores(rows, train_on(docs, labels), keep=["document"]).where("predicted = 0").select("document.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that more than a twentieth of their source's different documents hold."""
    out = drop_boilerplate(docs, _source(docs), ratio=0.05, least_pages=5)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group linked by a similarity of 0.8 on five-word shingles."""
    gone = near_duplicates(docs, width=5, percent=80).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*_all(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources weigh 1, 2, 3 in turn, none is used over three times."""
    taken = mix(docs, _source(docs), weights=(1, 2, 3), repeats=3).where("copies > 0")
    return taken.select("document", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("document.*")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text with an end id, their number, and SHA-256 of ids and of the text that they decode to."""
    out = encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)
    return out.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("sentencepiece", sentencepiece)]

#: Training, sketches and tokens can't be said in SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what lies between them is written, so a lost executor never costs a finished stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
