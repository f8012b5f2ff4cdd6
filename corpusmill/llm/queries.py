"""The queries of this subpackage by name: each runs one operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.exact_dedup import deduplicate
from corpusmill.llm.hard_negatives import hard_negatives
from corpusmill.llm.html_text import extract_text
from corpusmill.llm.line_dedup import drop_boilerplate
from corpusmill.llm.minhash_dedup import near_duplicates
from corpusmill.llm.mixing import mix
from corpusmill.llm.quality_rules import quality
from corpusmill.llm.sentencepiece_codec import encode_texts
from corpusmill.llm.substring_dedup import remove_repeats
from corpusmill.llm.token_counts import token_counts
from corpusmill.llm.toxicity import held_out, toxicity_scores, train_on
from corpusmill.llm.vector_search import top_k
from corpusmill.llm.whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 50-word windows that a smaller id has first.

    Null, empty and short texts lose nothing; of rows with one id and text each counts alike. An empty table gives no rows, and
    columns besides id and text are left out.
    """
    return remove_repeats(_table(spark, sf_dir, "documents"), window=50, with_text=False)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under four-word shingles and a similarity of 0.8.

    Null and empty texts are linked with nothing; equal texts are one component whose smallest id stays. An empty table gives no
    rows, very long texts are compared whole, and columns besides id and text are left out.
    """
    return near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix of sources takes.

    Null texts have size 0, a null source comes last; ties in the seeded order go by id. Repeated rows are each taken for
    themselves, and an empty table gives no rows.
    """
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix(docs, F.col("source"), weights=(1, 2, 3), repeats=3)
    return mixed.select("document.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its source's boilerplate lines; the source stands for the site.

    Null texts stay null (the digest is of an empty text), a null source is a site of its own, copies of a page count once.
    Long texts are whole, repeated rows all stay, and an empty table gives no rows.
    """
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    kept = drop_boilerplate(docs, F.col("source"), ratio=0.05, least_pages=5, counts=True)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every text, and whether it has more than 2,048.

    Null and empty texts have none; very long texts are counted whole, repeated rows each for itself, and an empty table gives
    no rows.
    """
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity under a model of the labelled rows that aren't held out, with its offending sentences.

    Null and empty texts have the score of a text without sentences; without labels all are clean. Repeated rows are each
    scored, long texts whole, and an empty table gives no rows.
    """
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity_scores(docs, train_on(docs, _table(spark, sf_dir, "labels")), worst=True)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", F.col("worst").alias("offending_sentences"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page.

    Null and empty pages have an empty text; repeated rows are each read, long pages whole, and an empty table gives no rows.
    """
    return extract_text(_table(spark, sf_dir, "pages"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text as digests, and of what they decode to.

    Null and empty texts are the end id alone; long texts are encoded whole, repeated rows each for itself, and an empty table
    gives no rows.
    """
    return encode_texts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


def op9_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other vectors of each hundredth vector.

    Ties go to smaller ids; null vectors and such with null or non-finite components take no part, and an empty table gives
    no rows.
    """
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of every document, with bands by its language.

    Null and empty texts fail the base rules; rows without language are a group of their own, repeated rows each count, long
    texts are judged whole, and an empty table gives no rows.
    """
    return quality(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), language=F.col("lang"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in three batches of falling ids through a new digest index, so that the largest id of equal texts stays.

    Null texts count as empty; rows that repeat an id and text have the same result, and an empty table gives no rows.
    """
    return deduplicate(_table(spark, sf_dir, "documents"), batches=3)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of each hundredth vector and its five positives; every seventh row has the next label first.

    Ties go to smaller ids; rows without label or with an unusable vector take no part, and an empty table gives no rows.
    """
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on the eight largest components of their covariance.

    Unusable vectors go, repeated rows each count, and an empty table gives no rows. A deviation too large for a long is null.
    """
    out = whiten(_table(spark, sf_dir, "embeddings"), components=8)
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_minhash_dedup": op2_minhash_dedup,
        "op3_mixing": op3_mixing,
        "op4_line_dedup": op4_line_dedup,
        "op5_token_counts": op5_token_counts,
        "op6_toxicity": op6_toxicity,
        "op7_html_text": op7_html_text,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_vector_search": op9_vector_search,
        "op10_quality_rules": op10_quality_rules,
        "op11_exact_dedup": op11_exact_dedup,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_whitening": op13_whitening,
    }


_SPLIT = r"list_filter(regexp_split_to_array({x}, '[\x20\x09-\x0D]+'), lambda v: v <> '')"
_WORDS = _SPLIT.format(x="coalesce(text, '')")
_LOWER = _SPLIT.format(x="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

ORACLE = {
    "op1_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
        hit AS (SELECT doc_id, i FROM win JOIN (SELECT s, min(doc_id) AS m FROM win GROUP BY s) USING (s) WHERE m < doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hit),
        word AS (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS p FROM w),
        kept AS (SELECT doc_id, string_agg(v, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
        SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op2_minhash_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_LOWER} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1) + 1))) AS i FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
            GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (max(x.n) + max(y.n) - count(*))),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, c = doc_id AS kept FROM (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY 1) LEFT JOIN n USING (doc_id)""",
    "op3_mixing": f"""
        WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, CAST('0x' || substr(md5('17|' || doc_id || '|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w FROM d GROUP BY source),
        r AS (SELECT *, sum(s) OVER () AS total, sum(w) OVER () AS shared, coalesce(sum(3 * s) OVER o, 0) AS before, coalesce(sum(w) OVER o, 0) AS used, 3 * s / w AS ratio FROM s
            WINDOW o AS (ORDER BY 3 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        u AS (SELECT arg_min((total - before) / (shared - used), (ratio, source)) AS unit FROM r WHERE 3 * s > w * ((total - before) / (shared - used))),
        t AS (SELECT source, s, least(CAST(3 * s AS DOUBLE), w * CAST(unit AS DOUBLE)) AS target, CASE WHEN s > 0 THEN CAST(floor(round_even(least(CAST(3 * s AS DOUBLE), w * CAST(unit AS DOUBLE)), 0) / s) AS BIGINT) ELSE 1 END AS times FROM s, u),
        c AS (SELECT d.*, t.s, t.target, t.times, greatest(CAST(round_even(t.target, 0) AS BIGINT) - t.times * t.s, 0) AS rest, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, s AS source_size, target, CAST(size * (times + CASE WHEN times < 3 AND upto - size / 2 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c""",
    "op4_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, source, pos, line, trim(line, chr(32) || chr(9) || chr(13)) AS bare
            FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
        ), pages AS (SELECT source, coalesce(text, '') AS page, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2),
        totals AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
        often AS (
            SELECT l.source, l.bare FROM (SELECT l.source, bare, count(DISTINCT doc_id) AS n FROM lines l SEMI JOIN pages USING (doc_id) WHERE bare <> '' GROUP BY 1, 2) l
            JOIN totals t ON l.source IS NOT DISTINCT FROM t.source WHERE n >= 5 AND n > 0.05 * pages
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE o.bare IS NOT NULL) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.bare IS NULL), '')) AS kept_sha256
        FROM lines l LEFT JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND l.bare = o.bare
        GROUP BY doc_id""",
    "op9_vector_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0
        ), pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM pairs QUALIFY rank <= 10""",
    "op11_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
    "op12_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0
        ), p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
