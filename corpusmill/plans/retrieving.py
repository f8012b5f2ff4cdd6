"""Queries on retrieval. Vectors are embeddings, queries are benchmark texts, documents are documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import joins, retrieval
from corpusmill.plans.registry import Tables, query

_RAW = "list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_COS = f"floor({_RAW} * 1000.0 + 0.5) / 1000.0"
_W4 = "list_distinct(list_filter(regexp_split_to_array(translate(lower(text), 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿ', 'aaaaaaeeeeiiiiooooouuuuncyy'), '[^a-z0-9]+'), lambda x: length(x) >= 4))"


@query("q_cosine_topk", "V1 S7 V19", f"""
    SELECT v.vec_id, {_COS} AS score FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id = 7) q WHERE v.vec_id <> 7 AND v.label IN (1, 2, 3) ORDER BY {_RAW} DESC, v.vec_id LIMIT 20""")
def cosine_topk(t: Tables) -> DataFrame:
    where = (F.col("vec_id") != 7) & F.col("label").isin(1, 2, 3) & retrieval.valid_vector(F.col("embedding"), 64)
    return retrieval.similar(t.embeddings, t.embeddings.where("vec_id = 7"), "vec_id", "embedding", 20, where, 3)


@query("q_lexical", "V8", f"""
    WITH i AS (SELECT doc_id, unnest({_W4}) AS word FROM documents), q AS (SELECT item_id, {_W4} AS w FROM benchmark),
    a AS (SELECT item_id, len(w) AS n, unnest(w) AS word FROM q), h AS (SELECT item_id, doc_id, count(*) AS hits, max(n) AS n FROM i JOIN a USING (word) GROUP BY 1, 2),
    s AS (SELECT item_id, doc_id, hits, floor(hits / n * 10000.0 + 0.5) / 10000.0 AS coverage FROM h)
    SELECT item_id, doc_id, hits, coverage, CAST(row_number() OVER (PARTITION BY item_id ORDER BY coverage DESC, doc_id) AS INT) AS rank FROM s QUALIFY rank <= 10""")
def lexical(t: Tables) -> DataFrame:
    return retrieval.lexical(t.documents, "doc_id", "text", t.benchmark, "item_id", "text", 10)


def _lists(t: Tables) -> tuple[DataFrame, DataFrame]:
    a = t.part.where("p_size <= 30").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"))
    return a, t.part.where("p_size >= 20").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("score"))


_AB = "a AS (SELECT p_partkey AS id, p_retailprice AS score FROM part WHERE p_size <= 30), b AS (SELECT p_partkey AS id, p_size / 50.0e0 AS score FROM part WHERE p_size >= 20)"


@query("q_hybrid", "V3 U5", f"""
    WITH {_AB}, s AS (SELECT id, score / max(score) OVER () AS s FROM a)
    SELECT coalesce(s.id, b.id) AS id, floor(CASE WHEN s.id IS NULL THEN b.score * 0.95e0 + 0.08e0 ELSE s.s * 1.15e0 + 0.25e0 + coalesce(b.score * 0.85e0, 0.0e0) END * 10000.0e0 + 0.5e0) / 10000.0e0 AS score,
        CASE WHEN s.id IS NULL THEN 'lexical' WHEN b.id IS NULL THEN 'semantic' ELSE 'both' END AS found_by FROM s FULL JOIN b ON s.id = b.id""")
def hybrid(t: Tables) -> DataFrame:
    return retrieval.hybrid(*_lists(t), "id")


@query("q_dual", "V4", f"""
    WITH {_AB}, o AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS r FROM (SELECT id, score / 2500.0e0 AS score FROM a))
    SELECT coalesce(o.id, b.id) AS id, floor((greatest(coalesce(o.score, 0.0e0), coalesce(b.score * 0.93e0, 0.0e0)) + CASE WHEN o.id IS NOT NULL AND b.id IS NOT NULL THEN 0.08e0 ELSE 0.0e0 END + CASE WHEN r <= 3 THEN 0.04e0 ELSE 0.0e0 END) * 10000.0e0 + 0.5e0) / 10000.0e0 AS score
    FROM o FULL JOIN b ON o.id = b.id""")
def dual(t: Tables) -> DataFrame:
    a, b = _lists(t)
    return retrieval.dual(a.withColumn("score", F.col("score") / 2500.0), b, "id")


_W3 = "list_distinct(list_filter(regexp_split_to_array(translate(lower({x}), 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿ', 'aaaaaaeeeeiiiiooooouuuuncyy'), '[^a-z0-9]+'), lambda v: length(v) >= 3))"


@query("q_accept", "V5", f"""
    WITH x AS (SELECT item_id, text AS a, CASE item_id % 4 WHEN 0 THEN text WHEN 1 THEN text || ' more words' WHEN 2 THEN substr(text, 1, 40) ELSE 'something else 7 entirely' END AS b FROM (SELECT item_id, CASE WHEN item_id % 8 = 0 THEN text || ' 77' ELSE text END AS text FROM benchmark)),
    y AS (SELECT *, {_W3.format(x="a")} AS wa, {_W3.format(x="b")} AS wb, list_filter(regexp_split_to_array(a, '[^0-9]+'), lambda v: v <> '') AS na, regexp_split_to_array(b, '[^0-9]+') AS nb, length(b) / greatest(length(a), 1) AS r FROM x)
    SELECT item_id, len(list_intersect(wa, wb)) / greatest(len(wa), 1) >= 0.5 AND len(list_filter(na, lambda v: NOT list_contains(nb, v))) = 0 AND r BETWEEN 0.45 AND 3.2 AS accepted FROM y""")
def accept(t: Tables) -> DataFrame:
    m = F.col("item_id") % 4
    rows = t.benchmark.select("item_id", F.when(F.col("item_id") % 8 == 0, F.concat("text", F.lit(" 77"))).otherwise(F.col("text")).alias("text"))
    rewritten = F.when(m == 0, F.col("text")).when(m == 1, F.concat(F.col("text"), F.lit(" more words"))).when(m == 2, F.substring("text", 1, 40)).otherwise(F.lit("something else 7 entirely"))
    return rows.select("item_id", retrieval.accept_rewrite(F.col("text"), rewritten).alias("accepted"))


@query("q_intent", "V6", """
    WITH s AS (SELECT doc_id, contains(lower(text), 'license')::INT + contains(lower(text), 'apache')::INT + 1.2e0 * contains(lower(text), 'legal')::INT AS a, contains(lower(text), 'token')::INT + contains(lower(text), 'password')::INT + 1.2e0 * contains(lower(text), 'secret')::INT AS b FROM documents)
    SELECT doc_id, CASE WHEN a >= b THEN 'licensing' ELSE 'security' END AS name, floor(greatest(0.35e0, least(0.92e0, greatest(a, b) / 4.5e0)) * 1000.0e0 + 0.5e0) / 1000.0e0 AS confidence FROM s WHERE greatest(a, b) > 0""")
def intent(t: Tables) -> DataFrame:
    found = retrieval.intent(F.col("text"), {"licensing": ("legal", ["license", "apache"]), "security": ("secret", ["token", "password"])})
    return t.documents.select("doc_id", found.alias("i")).where("i IS NOT NULL").select("doc_id", "i.name", "i.confidence")


@query("q_id_first", "", "SELECT o_orderkey FROM orders WHERE starts_with(CAST(o_orderkey AS VARCHAR), '1234') ORDER BY o_orderkey LIMIT 10")
def id_first(t: Tables) -> DataFrame:
    return retrieval.id_first(t.orders.select("o_orderkey", F.col("o_orderpriority").alias("text")), "o_orderkey", "text", "N1234", 10).select("o_orderkey")


@query("q_family_score", "", """
    WITH q AS (SELECT ['the', 'there', 'and', 'thing'] AS ws), d AS (SELECT doc_id, ws, string_split(lower(strip_accents(text)), chr(10)) AS p FROM documents, q),
    t AS (SELECT doc_id, ws, list_transform(p, lambda x: string_split_regex(x, '[^a-z0-9]+')) AS p FROM d),
    s AS (SELECT doc_id, floor((len(list_intersect(ws, flatten(p))) / 4 * 1.55e0 + len(list_intersect(ws, p[1])) / 4 * 0.30e0 + len(list_filter(p[1:3], lambda x: list_has_all(x, ws))) * 0.32e0) * 1000.0e0 + 0.5e0) / 1000.0e0 AS score FROM t)
    SELECT doc_id, score FROM s WHERE score >= 1.0e0""")
def family_score(t: Tables) -> DataFrame:
    segments = F.split("text", "\n")
    return t.documents.select("doc_id", retrieval.family_score(segments, segments[0], F.lit("the there and thing of")).alias("score")).where("score >= 1.0")


@query("q_rerank", "V16", """
    WITH o AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS new_rank FROM part WHERE p_size <= 25) SELECT p_partkey, p_name, new_rank FROM o JOIN part USING (p_partkey) WHERE p_type <> 'ECONOMY'""")
def rerank(t: Tables) -> DataFrame:
    order = joins.numbered(t.part.where("p_size <= 25").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.col("p_partkey")], "r")
    return retrieval.rerank(t.part.where("p_type <> 'ECONOMY'").select("p_partkey", "p_name"), "p_partkey", order, "r")


@query("q_vec_consistency", "V20 V19", """
    WITH c AS (SELECT (SELECT count(*) FROM documents) AS in_table, (SELECT count(*) FROM embeddings) AS in_store, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS missing, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS orphaned),
    d AS (SELECT *, floor(abs(in_table - in_store) / in_table * 10000.0e0 + 0.5e0) / 10000.0e0 AS drift FROM c)
    SELECT *, CASE WHEN drift >= 0.25 THEN 'high' WHEN drift >= 0.1 THEN 'medium' ELSE 'low' END AS severity FROM d""")
def vec_consistency(t: Tables) -> DataFrame:
    return retrieval.store_drift(t.documents.select(F.col("doc_id").alias("id")), t.embeddings.select(F.col("vec_id").alias("id")), "id")
