"""Queries on how documents fit queries, and on what a model and rules over it say of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import alignment
from corpusmill.plans.registry import Tables, query

_NORM = "trim(regexp_replace(regexp_replace(translate(lower({x}), 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿ', 'aaaaaaeeeeiiiiooooouuuuncyy'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_R2 = "floor(({x}) * 100.0e0 + 0.5e0) / 100.0e0".format


@query("q_alignment_terms", "C3", f"""
    WITH x AS (SELECT doc_id, {_NORM.format(x="coalesce(text, '')")} AS t, CASE doc_id % 3 WHEN 0 THEN 'The and zzzz there' WHEN 1 THEN 'license legal token' ELSE 'de' END AS q, (doc_id % 11) / 10.0e0 AS r, doc_id % 4 AS m FROM documents),
    y AS (SELECT *, list_filter(list_distinct(string_split({_NORM.format(x="q")}, ' ')), lambda w: length(w) >= 3) AS w FROM x),
    z AS (SELECT *, len(list_filter(w, lambda v: contains(t, v))) AS matched, CASE WHEN m > 0 THEN contains(t, 'legal')::INT END AS il, CASE WHEN m > 0 THEN len(list_filter(['license', 'apache', 'the'], lambda v: contains(t, v))) ELSE 0 END AS it, CASE WHEN m > 1 THEN contains(t, 'secret key')::INT END AS sl, CASE WHEN m > 1 THEN len(list_filter(['token', 'pass word'], lambda v: contains(t, v))) ELSE 0 END AS st,
        CASE WHEN m > 0 THEN 0.6e0 ELSE 0.0e0 END AS ic, CASE m WHEN 2 THEN 0.5e0 WHEN 3 THEN 0.9e0 ELSE 0.0e0 END AS sc, least(r, 1.0e0) AS found FROM y),
    s AS (SELECT *, CASE WHEN len(w) > 0 THEN matched / len(w) ELSE 0.0e0 END * 0.42e0 + found * 0.34e0 + (CASE WHEN il = 1 THEN 0.16e0 ELSE 0.0e0 END + least(0.18e0, it * 0.05e0)) * ic + (CASE WHEN sl = 1 THEN 0.28e0 ELSE 0.0e0 END + least(0.34e0, st * 0.08e0)) * sc AS a, st = 0 AND coalesce(sl, 0) = 0 AS misses FROM z)
    SELECT doc_id, CASE WHEN t = '' THEN 0.0e0 ELSE {_R2(x="least(1.2e0, a * CASE WHEN len(w) >= 3 AND matched <= 1 AND misses THEN 0.58e0 ELSE 1.0e0 END * CASE WHEN sc >= 0.72 AND misses AND found < 0.8 THEN 0.72e0 ELSE 1.0e0 END)")} END AS score,
        CAST(CASE WHEN t = '' THEN 0 ELSE matched END AS INT) AS matched, CAST(CASE WHEN t = '' THEN 0 ELSE it END AS INT) AS intent_terms, CAST(CASE WHEN t = '' THEN 0 ELSE st END AS INT) AS subtopic_terms FROM s""")
def alignment_terms(t: Tables) -> DataFrame:
    m = F.col("doc_id") % 4
    asked = F.when(F.col("doc_id") % 3 == 0, "The and zzzz there").when(F.col("doc_id") % 3 == 1, "license legal token").otherwise("de")
    about = lambda label, terms, sure: F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, terms)).alias("terms"), sure.alias("confidence"))
    intent = F.when(m > 0, about("Legal", ["License", "apache", "the"], F.lit(0.6)))
    subtopic = F.when(m > 1, about("Secret key", ["token", "pass-word"], F.when(m == 2, 0.5).otherwise(0.9)))
    found = alignment.alignment(F.col("text"), asked, (F.col("doc_id") % 11) / 10.0, intent, subtopic)
    return t.documents.select("doc_id", found.alias("a")).select("doc_id", "a.score", "a.matched", "a.intent_terms", "a.subtopic_terms")


@query("q_direct_choice", "V9", """
    WITH h AS (SELECT o_custkey, o_orderkey, o_totalprice / 600000.0e0 AS raw, lower(o_orderpriority) || CASE WHEN o_orderkey % 3 = 0 THEN ' ' || lower(c_mktsegment) ELSE '' END AS t, lower(c_mktsegment) AS seg, (o_orderkey % 4) / 10.0e0 AS sub FROM orders JOIN customer ON c_custkey = o_custkey),
    n AS (SELECT *, contains(t, seg)::INT + contains(t, 'urgent')::INT + contains(t, 'medium')::INT AS overlap, raw / max(raw) OVER (PARTITION BY o_custkey) AS norm FROM h),
    v AS (SELECT *, norm * 1.45e0 + overlap / 3 * 2.2e0 + sub * 2.8e0 AS v FROM n), f AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY v DESC, o_orderkey) = 1)
    SELECT f.o_custkey, f.o_orderkey, floor(f.v * 10000.0e0 + 0.5e0) / 10000.0e0 AS value, CAST(f.overlap AS INT) AS overlap, f.norm >= 0.9 AND (f.raw - coalesce((SELECT max(raw) FROM n WHERE n.o_custkey = f.o_custkey AND n.o_orderkey <> f.o_orderkey), 0.0e0) >= 0.04 OR f.overlap >= 2) AS strong FROM f""")
def direct_choice(t: Tables) -> DataFrame:
    hits = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey").withColumn("raw", F.col("o_totalprice") / 600000.0)
    text = F.concat_ws(" ", "o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, F.col("c_mktsegment")))
    return alignment.direct_choice(hits, "o_custkey", "o_orderkey", "raw", text, F.concat_ws(" ", "c_mktsegment", F.lit("urgent, medium")), (F.col("o_orderkey") % 4) / 10.0)


@query("q_visible", "C15", """
    WITH e AS (SELECT o_custkey, o_orderkey AS k, o_totalprice / 600000.0e0 AS p, (o_orderkey % 100) / 99.0e0 AS r, (o_orderkey % 50) / 49.0e0 AS u, (o_orderkey % 20) / 19.0e0 AS rel, (o_orderkey % 10) / 9.0e0 AS later, (o_orderkey % 7) / 6.0e0 AS obs, o_orderdate FROM orders),
    l AS (SELECT o_custkey, arg_min(k, (-p, k)) AS canonical, date_diff('day', min(o_orderdate), max(o_orderdate)) / 365.25e0 AS spread, CASE c_nationkey % 3 WHEN 0 THEN 'in_review' WHEN 1 THEN 'strained' ELSE 'stable' END AS status FROM e JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey, c_nationkey),
    o AS (SELECT l.*, p AS op, obs AS oo, later AS ol, r AS ore, p * 0.45e0 + r * 0.15e0 + u * 0.25e0 + rel * 0.1e0 + later * 0.05e0 AS own FROM l JOIN e ON e.o_custkey = l.o_custkey AND k = canonical),
    a AS (SELECT e.o_custkey, k, p * 0.35e0 + r * 0.25e0 + u * 0.28e0 + rel * 0.07e0 + later * 0.05e0 AS c, p, r, u, own, op FROM e JOIN o USING (o_custkey) WHERE k <> canonical AND r >= 0.68 AND u >= 0.34 AND obs < 0.9 AND status IN ('in_review', 'strained') AND spread >= 3.5),
    t AS (SELECT * FROM a WHERE c >= own - 0.06e0 OR (u >= 0.55 AND r >= 0.78 AND p >= op - 0.32e0) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY c DESC, p DESC, r DESC, k) = 1)
    SELECT o.o_custkey, coalesce(t.k, canonical) AS representative, CASE WHEN t.k IS NOT NULL THEN 'updates' WHEN oo >= 0.5 THEN 'least_displaced' WHEN ol >= 0.34 THEN 'taken_up_later' WHEN ore >= 0.55 THEN 'recent' ELSE 'central' END AS reason FROM o LEFT JOIN t USING (o_custkey)""")
def visible(t: Tables) -> DataFrame:
    k, n = F.col("o_orderkey"), F.col("c_nationkey")
    entries = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", (F.col("o_totalprice") / 600000.0).alias("priority"), ((k % 100) / 99.0).alias("recency"), ((k % 50) / 49.0).alias("update"), ((k % 20) / 19.0).alias("relations"), ((k % 10) / 9.0).alias("later"), ((k % 7) / 6.0).alias("obsolete"))
    lines = entries.groupBy("o_custkey").agg(F.min(F.struct((-F.col("priority")).alias("p"), "o_orderkey"))["o_orderkey"].alias("canonical"), (F.datediff(F.max("o_orderdate"), F.min("o_orderdate")) / 365.25).alias("spread"))
    status = F.when(n % 3 == 0, "in_review").when(n % 3 == 1, "strained").otherwise("stable")
    lines = lines.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), status.alias("status")), "o_custkey")
    return alignment.visible_representatives(entries.drop("o_orderdate"), "o_custkey", "o_orderkey", lines)


_SAID = ["Se complementa el dictamen.", "Aclara el alcance", "Imparte instrucciones: debe cumplirse", "Se abstiene de tomar razón", "Hay JUICIOS pendientes", "Competencia exclusiva del Servicio Electoral", "No dice nada", "Corresponde pagar"]


@query("q_merged_metadata", "C22", f"""
    WITH x AS (SELECT doc_id, doc_id % 8 AS m, ['abstains', 'litigious', 'normal', 'residual'][doc_id // 8 % 4 + 1] AS intervention, doc_id // 32 % 2 = 1 AS closes, (doc_id % 100) / 100.0e0 AS cur, (doc_id % 50) / 50.0e0 AS cen, ['undetermined', 'in_force', 'displaced'][doc_id % 3 + 1] AS validity, CASE WHEN doc_id % 5 = 0 THEN 'doctrinal_entry' ELSE 'context' END AS reading,
        CASE doc_id % 6 WHEN 4 THEN NULL WHEN 5 THEN 'limitation' ELSE 'application' END AS mr, CASE WHEN doc_id % 7 = 0 THEN 'historical' END AS mv, CASE WHEN doc_id % 2 = 1 THEN 0.5e0 END AS mc FROM documents),
    f AS (SELECT *, m = 2 OR m = 7 AS g, m = 5 AS e, coalesce(mr = 'application', false) AS app, m = 2 OR m = 7 OR m = 5 OR cur >= 0.56 AS entry FROM x),
    w AS (SELECT *, CASE WHEN NOT app THEN 0 WHEN m = 0 THEN 1 WHEN m = 1 THEN 2 WHEN m = 2 AND cur >= 0.58 AND cen >= 0.3 THEN 3 WHEN intervention = 'abstains' AND (m = 3 OR g OR e OR reading = 'doctrinal_entry') THEN 4 WHEN intervention = 'litigious' AND (m = 4 OR e OR g) THEN 5 WHEN closes AND (e OR g) THEN 6 ELSE 0 END AS o FROM f),
    r AS (SELECT doc_id, [NULL, 'complement', 'clarification', 'operational_rule', 'abstention', 'litigious', 'competence_closure'][o + 1] AS reason, coalesce([NULL, 'complement', 'clarification', 'current_rule', 'abstention', 'litigious', 'competence_closure'][o + 1], mr, 'context') AS role,
        CASE o WHEN 0 THEN reading WHEN 3 THEN 'current_state' WHEN 4 THEN CASE WHEN entry THEN 'doctrinal_entry' ELSE 'context' END WHEN 5 THEN CASE WHEN g OR cur >= 0.56 THEN 'current_state' ELSE 'doctrinal_entry' END ELSE 'doctrinal_entry' END AS reading_role,
        CASE WHEN o <= 2 THEN coalesce(mv, validity) WHEN validity <> 'undetermined' THEN validity WHEN o = 3 OR (o = 4 AND entry) THEN 'in_force' ELSE 'in_force_strained' END AS validity, CASE WHEN o = 6 THEN 'residual' ELSE intervention END AS intervention,
        floor(least(1.0e0, coalesce(mc, 0.55e0) + [0.0e0, 0.06e0, 0.05e0, 0.08e0, 0.07e0, 0.08e0, 0.08e0][o + 1]) * 1000.0e0 + 0.5e0) / 1000.0e0 AS confidence FROM w)
    SELECT doc_id, reason, CASE WHEN role <> 'limitation' THEN role WHEN intervention = 'abstains' THEN 'abstention' WHEN intervention = 'litigious' THEN 'litigious' WHEN validity = 'displaced' THEN 'adjustment' ELSE 'clarification' END AS role, reading_role, validity, intervention, confidence, CASE WHEN confidence < 0.58 THEN 'needs_review' ELSE 'ready' END AS review FROM r""")
def merged_metadata(t: Tables) -> DataFrame:
    n = F.col("doc_id")
    one = lambda names, at: F.element_at(F.array(*[F.lit(x) for x in names]), (at + 1).cast("int"))
    rows = t.documents.select(
        "doc_id", one(_SAID, n % 8).alias("said"), F.lit("context").alias("role"), one(["abstains", "litigious", "normal", "residual"], F.floor(n / 8) % 4).alias("intervention"), (F.floor(n / 32) % 2 == 1).alias("closes_competence"),
        ((n % 100) / 100.0).alias("currentness"), ((n % 50) / 50.0).alias("centrality"), one(["undetermined", "in_force", "displaced"], n % 3).alias("validity"), F.when(n % 5 == 0, "doctrinal_entry").otherwise("context").alias("reading_role"), F.lit(0.55).alias("confidence"), F.lit(False).alias("supports"),
        F.when(n % 6 == 5, "limitation").when(n % 6 != 4, "application").alias("model_role"), F.lit(None).cast("string").alias("model_reading_role"), F.when(n % 7 == 0, "historical").alias("model_validity"), F.lit(None).cast("string").alias("model_intervention"), F.when(n % 2 == 1, 0.5).alias("model_confidence"),
    )
    return alignment.merged_metadata(rows, F.col("said")).select("doc_id", "reason", "role", "reading_role", "validity", "intervention", "confidence", "review")
