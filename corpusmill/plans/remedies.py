"""Queries on remedies for faulty rows, key pools, the order of clusters and the documents to read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import joins, remedies
from corpusmill.plans.registry import Tables, query

# labels of a part: with ends, underscores, double blanks, repeats and holes
_LABELS = "CASE p_partkey % 6 WHEN 0 THEN ['  ' || p_name, p_brand] WHEN 1 THEN [replace(p_name, ' ', '_'), p_name] WHEN 2 THEN [replace(p_name, ' ', '  '), upper(p_name), p_brand] WHEN 3 THEN [p_name, ' ', p_name || ' '] WHEN 4 THEN [p_name || '_', '_'] ELSE [p_name, p_type] END"
_NORMAL = f"""
    a AS (SELECT p_partkey, p_size, {_LABELS} AS l FROM part),
    e AS (SELECT p_partkey, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM a),
    s AS (SELECT p_partkey, i, x, trim(x) AS t, replace(trim(x), '_', ' ') AS u, trim(regexp_replace(replace(trim(x), '_', ' '), '\\s+', ' ', 'g')) AS v FROM e),
    h AS (SELECT p_partkey, min(i) FILTER (WHERE v = '') AS hole FROM s GROUP BY 1),
    k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, lower(v) ORDER BY i) AS nth FROM s JOIN h USING (p_partkey)),
    n AS (SELECT p_partkey, max(hole) IS NOT NULL AS empty, string_agg(CASE WHEN hole IS NOT NULL THEN x WHEN nth = 1 THEN v END, '|' ORDER BY i) AS labels,
        concat_ws(',', CASE WHEN bool_or(x <> t AND i <= coalesce(hole, i)) THEN 'trim_whitespace' END, CASE WHEN bool_or(t <> u AND i <= coalesce(hole, i)) THEN 'snake_case_to_spaces' END,
            CASE WHEN bool_or(u <> v AND i <= coalesce(hole, i)) THEN 'collapse_whitespace' END, CASE WHEN bool_or(nth > 1 AND i < coalesce(hole, i + 1)) THEN 'dedupe_normalized_duplicates' END) AS applied FROM k GROUP BY 1)"""


def _labels(t: Tables) -> DataFrame:
    m, name, brand = F.col("p_partkey") % 6, F.col("p_name"), F.col("p_brand")
    glue = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    spaced = lambda by: F.replace(name, F.lit(" "), F.lit(by))
    lists = (
        F.when(m == 0, F.array(glue("  ", name), brand)).when(m == 1, F.array(spaced("_"), name)).when(m == 2, F.array(spaced("  "), F.upper(name), brand))
        .when(m == 3, F.array(name, F.lit(" "), glue(name, " "))).when(m == 4, F.array(glue(name, "_"), F.lit("_"))).otherwise(F.array(name, F.col("p_type")))
    )
    return t.part.select("p_partkey", "p_size", lists.alias("raw")).withColumn("x", remedies.normal_labels(F.col("raw")))


@query("q_label_forms", "F46 Q8", f"WITH {_NORMAL} SELECT p_partkey, labels, applied, empty FROM n")
def label_forms(t: Tables) -> DataFrame:
    return _labels(t).select("p_partkey", F.array_join("x.labels", "|").alias("labels"), F.array_join("x.applied", ",").alias("applied"), F.col("x.empty").alias("empty"))


@query("q_label_swap", "Q8", f"""
    WITH {_NORMAL}, o AS (SELECT p_partkey, array_to_string(l, '|') AS seen, labels AS new, CASE WHEN p_size % 4 = 0 THEN 'else' ELSE array_to_string(l, '|') END AS held FROM a JOIN n USING (p_partkey)),
    b AS (SELECT * FROM o WHERE seen <> new ORDER BY p_partkey LIMIT 20)
    SELECT o.p_partkey, CASE WHEN b.seen = o.held THEN b.new ELSE o.held END AS labels, CASE WHEN b.p_partkey IS NULL THEN 'none' WHEN b.seen = o.held THEN 'applied' ELSE 'conflict' END AS outcome FROM o LEFT JOIN b USING (p_partkey)""")
def label_swap(t: Tables) -> DataFrame:
    rows = _labels(t).select("p_partkey", "p_size", F.array_join("raw", "|").alias("seen"), F.array_join("x.labels", "|").alias("new"))
    stored = rows.select("p_partkey", F.when(F.col("p_size") % 4 == 0, "else").otherwise(F.col("seen")).alias("labels"))
    table, outcome = remedies.swapped(stored, rows.select("p_partkey", "seen", "new"), "p_partkey", "labels", 20)
    return table.join(outcome, "p_partkey", "left").withColumn("outcome", F.coalesce("outcome", F.lit("none")))


@query("q_format_noise", "Q11", f"""
    WITH a AS (SELECT p_partkey, array_to_string({_LABELS}, '|') AS l FROM part), s AS (SELECT 'underscore' AS sign, '_' AS mark UNION ALL SELECT 'double_space', '  ' UNION ALL SELECT 'tab', chr(9)),
    m AS (SELECT sign, p_partkey, row_number() OVER (PARTITION BY sign ORDER BY p_partkey) AS r FROM s JOIN a ON contains(l, mark))
    SELECT sign, count(p_partkey) AS n, coalesce(string_agg(p_partkey, ',' ORDER BY p_partkey) FILTER (WHERE r <= 50), '') AS ids FROM s LEFT JOIN m USING (sign) GROUP BY 1""")
def format_noise(t: Tables) -> DataFrame:
    found = remedies.format_noise(_labels(t).select("p_partkey", F.array_join("raw", "|").alias("l")), "p_partkey", "l", {"underscore": "_", "double_space": "  ", "tab": "\t"})
    return found.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("q_blocked", "Q10", """
    WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN 'x' END AS title, CASE WHEN o_orderkey % 4 > 0 THEN 'x' ELSE ' ' END AS summary, CASE WHEN o_orderkey % 5 > 0 THEN 'x' ELSE '' END AS analysis, o_orderpriority <> '5-LOW' AS topic, o_custkey % 4 AS labels, o_custkey % 2 AS sources, o_custkey % 3 AS flags,
        CASE WHEN o_orderstatus = 'F' THEN true ELSE o_orderstatus = 'O' AND o_orderkey % 2 = 0 END AS found FROM orders),
    m AS (SELECT *, (title IS NULL)::INT + (summary = ' ')::INT + (analysis = '')::INT AS n, topic AND labels >= 2 AND (sources > 0 OR flags >= 2) AS strong FROM o)
    SELECT o_orderkey, concat_ws(',', CASE WHEN title IS NULL THEN 'title' END, CASE WHEN summary = ' ' THEN 'summary' END, CASE WHEN analysis = '' THEN 'analysis' END) AS missing,
        CASE WHEN n = 1 AND strong THEN 'regenerate_from_existing_metadata' WHEN found THEN 'regenerate_from_source' ELSE 'needs_manual_semantic_review' END AS strategy, CASE WHEN n = 1 AND strong OR found AND n = 3 THEN 'medium' ELSE 'high' END AS risk,
        CASE WHEN n = 1 AND strong OR found THEN 'skip_until_write_guard_satisfied' ELSE 'needs_manual_semantic_review' END AS action FROM m WHERE n > 0""")
def blocked(t: Tables) -> DataFrame:
    k, c, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    origin = F.when(s == "O", F.when(k % 2 == 0, "feed").otherwise("missing_kv"))
    rows = t.orders.select(
        k, F.when(k % 3 > 0, "x").alias("title"), F.when(k % 4 > 0, "x").otherwise(" ").alias("summary"), F.when(k % 5 > 0, "x").otherwise("").alias("analysis"), F.when(F.col("o_orderpriority") != "5-LOW", "x").alias("topic"),
        (c % 4).alias("labels"), (c % 2).alias("sources"), (c % 3).alias("flags"), F.when(s == "F", "http://x").alias("url"), origin.alias("origin"),
    )
    out = remedies.blocked(rows, ["title", "summary", "analysis"], "topic", "labels", "sources", "flags", "url", "origin", may_write=False, apply=True)
    return out.select(k, F.array_join("missing", ",").alias("missing"), "strategy", "risk", "action")


@query("q_catalog_cleanup", "Q15", """
    WITH c AS (SELECT p_partkey FROM part WHERE NOT (contains(p_name, ' r') OR length(p_type) < 6)), l AS (SELECT l_partkey, count(*) AS links FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE contains(p_name, ' r') OR length(p_type) < 6) GROUP BY 1)
    SELECT coalesce(p_partkey, l_partkey) AS p_partkey, p_partkey IS NOT NULL AS in_catalog, coalesce(links, 0) AS links FROM c FULL JOIN l ON p_partkey = l_partkey""")
def catalog_cleanup(t: Tables) -> DataFrame:
    bad = F.contains("p_name", F.lit(" r")) | (F.length("p_type") < 6)
    catalog, links = remedies.without_malformed(t.part.select("p_partkey", "p_name", "p_type"), t.lineitem.select("l_partkey"), "p_partkey", "l_partkey", bad)
    counts = links.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("links"))
    return catalog.select("p_partkey", F.lit(True).alias("_c")).join(counts, "p_partkey", "full_outer").select("p_partkey", F.col("_c").isNotNull().alias("in_catalog"), F.coalesce("links", F.lit(0)).alias("links"))


@query("q_delegated", "Q21", """
    WITH c AS (SELECT event_id, CASE WHEN event_type <> 'click' THEN event_type END AS incident, 'lane' || user_id % 2 AS target FROM events)
    SELECT event_id, CASE WHEN incident IS NULL THEN 'preview_only' WHEN incident = 'error' AND target = 'lane0' THEN 'delegated' WHEN incident = 'error' THEN 'preview_only' ELSE 'blocked_by_semantic_gap' END AS verdict FROM c""")
def delegated(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame([("error", "lane0", True, "full"), ("error", "lane1", False, "preview_only"), ("purchase", "lane0", False, "partial")], "incident string, target string, allowed boolean, compatibility string")
    cases = t.events.select("event_id", F.when(F.col("event_type") != "click", F.col("event_type")).alias("incident"), F.concat(F.lit("lane"), (F.col("user_id") % 2).cast("string")).alias("target"))
    return remedies.delegated(cases, "incident", "target", rules).select("event_id", "verdict")


@query("q_key_choice", "X9", """
    WITH now AS (SELECT max(ts) AS t FROM events), p AS (SELECT s_suppkey AS k, s_nationkey, t, CASE WHEN s_suppkey % 5 = 0 THEN 'blocked' WHEN s_suppkey % 3 = 0 THEN 'exhausted' ELSE 'active' END AS status,
        CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN t + INTERVAL 12 HOUR WHEN s_suppkey % 7 = 0 THEN t + INTERVAL 90 SECOND END AS til, TIMESTAMP '2024-01-01' + to_seconds(CAST(s_suppkey * 37 % 101 AS INTEGER)) AS used FROM supplier, now),
    u AS (SELECT user_id AS k, count(*) >= 1 AS busy FROM events, now WHERE date_trunc('minute', ts) = date_trunc('minute', t) GROUP BY 1),
    w AS (SELECT *, CASE WHEN til > t THEN til WHEN busy THEN date_trunc('minute', t) + INTERVAL 1 MINUTE END AS til2 FROM p LEFT JOIN u USING (k)),
    g AS (SELECT s_nationkey, max(t) AS t, arg_min(k, (used, k)) FILTER (WHERE status <> 'blocked' AND til2 IS NULL) AS chosen, min(til2) FILTER (WHERE status <> 'blocked') AS wait FROM w GROUP BY 1)
    SELECT s_nationkey, chosen, CASE WHEN chosen IS NULL AND wait IS NOT NULL THEN CAST(greatest(1, ceil((epoch_us(wait) - epoch_us(t)) / 1e6)) AS INT) END AS retry_after FROM g""")
def key_choice(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    now = F.col("as_of")
    newest = t.events.agg(F.max("ts").alias("as_of"))
    rows = t.supplier.crossJoin(newest).select(
        k, "s_nationkey", now, F.lit("active").alias("status"), F.when((k % 7 == 0) & (k % 3 > 0) & (k % 5 > 0), now + F.make_dt_interval(secs=F.lit(90))).alias("exhausted_until"), F.timestamp_seconds(F.lit(1704067200) + (k * 37) % 101).cast(t.events.schema["ts"].dataType).alias("last_used")
    )
    failures = t.supplier.select(k, F.when(k % 5 == 0, "blocked").when(k % 3 == 0, "quota").otherwise("error").alias("reason")).where((F.col("reason") != "error") | (k % 7 > 0))
    as_of = F.lit(newest.first()[0]).cast(t.events.schema["ts"].dataType)  # one value
    pool = remedies.failed_keys(rows.drop("as_of"), failures, "s_suppkey", as_of)
    return remedies.chosen_keys(pool, "s_nationkey", "s_suppkey", t.events.select(F.col("user_id").alias("s_suppkey"), "ts"), 1, as_of)


@query("q_store_findings", "V20", """
    WITH s AS (SELECT vec_id, label % 4 > 0 AND vec_id % 6 > 0 AND label >= 2 AS whole, label % 3 AS model FROM embeddings WHERE vec_id % 9 > 0), m AS (SELECT d.doc_id, d.lang, s.*, CASE model WHEN 0 THEN 'en' WHEN 1 THEN 'fr' END AS name FROM documents d LEFT JOIN s ON doc_id = vec_id),
    c AS (SELECT count(*) AS rows, count(*) FILTER (WHERE vec_id IS NULL) AS a, count(*) FILTER (WHERE NOT whole) AS b, count(*) FILTER (WHERE name <> lang) AS d FROM m),
    f AS (SELECT rows, 'missing_vector' AS finding, a AS n FROM c UNION ALL SELECT rows, 'metadata_gap', b FROM c UNION ALL SELECT rows, 'model_mismatch', d FROM c)
    SELECT finding, n, CASE WHEN finding <> 'model_mismatch' AND n >= ceil(rows * 0.2) THEN 'high' ELSE 'medium' END AS severity FROM f WHERE n > 0""")
def store_findings(t: Tables) -> DataFrame:
    v, label = F.col("vec_id"), F.col("label")
    store = t.embeddings.where(v % 9 > 0).select(
        v.alias("doc_id"), F.when(label % 4 > 0, "x").otherwise(" ").alias("title"), F.when(v % 6 > 0, "x").alias("summary"), F.transform(F.sequence(F.lit(1), F.greatest(label, F.lit(1))), lambda i: F.when(i <= label, "tag").otherwise("")).alias("tags"),
        F.when(label % 3 == 0, "en").when(label % 3 == 1, "fr").otherwise(" ").alias("lang"),
    )
    return remedies.store_findings(t.documents.select("doc_id", "lang"), store, "doc_id", ["title", "summary"], "tags", "lang")


@query("q_clusters_by_query", "C17", """
    WITH m AS (SELECT p_brand, p_type, min(p_partkey) AS place FROM part GROUP BY 1, 2), a AS (SELECT p_type, CAST(avg(p_size) / 50 AS DECIMAL(18,4)) AS score FROM part WHERE p_type <> 'ECONOMY' GROUP BY 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY place, p_type) AS r FROM m)
    SELECT p_brand, floor(CAST(sum(CAST(coalesce(CAST(score AS DOUBLE), 0) * CASE WHEN r = 1 THEN 1.4e0 ELSE 1.0e0 END AS DECIMAL(20,8))) AS DOUBLE) * 10000.0e0 + 0.5e0) / 10000.0e0 AS query_score FROM r LEFT JOIN a USING (p_type) WHERE r <= 5 GROUP BY 1""")
def clusters_by_query(t: Tables) -> DataFrame:
    alignment = t.part.where("p_type <> 'ECONOMY'").groupBy("p_type").agg((F.avg("p_size") / 50).cast("decimal(18,4)").cast("double").alias("score"))
    return remedies.clusters_by_query(t.part.select("p_brand").distinct(), t.part.select("p_brand", "p_type", F.col("p_partkey").alias("place")), alignment, "p_brand", "p_type")


@query("q_key_documents", "C18", """
    WITH c AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey = max(o_orderkey) OVER w THEN 0 WHEN o_orderpriority = '1-URGENT' THEN 1 WHEN o_orderstatus = 'P' THEN 2 ELSE 3 END AS g, o_totalprice, o_orderdate FROM orders WINDOW w AS (PARTITION BY o_custkey)),
    f AS (SELECT *, count(*) FILTER (WHERE g < 3) OVER (PARTITION BY o_custkey) AS held, row_number() OVER (PARTITION BY o_custkey, g = 3 ORDER BY o_orderkey) AS r FROM c),
    p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE g WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE g END, floor(o_totalprice / 100000) DESC, o_orderkey % 3 DESC, o_orderdate DESC, o_orderkey) AS reading_place FROM f WHERE g < 3 OR r + held <= 5)
    SELECT o_custkey, o_orderkey, ['representative', 'core', 'pivot', 'influential'][g + 1] AS role, CAST(reading_place AS INT) AS reading_place FROM p WHERE reading_place <= 5""")
def key_documents(t: Tables) -> DataFrame:
    c = F.col
    top = t.orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"), F.lit("representative").alias("r"))
    named = F.array(F.when(c("r").isNotNull(), c("r")), F.when(c("o_orderpriority") == "1-URGENT", "core"), F.when(c("o_orderstatus") == "P", "pivot"), F.lit("influential"))
    rows = t.orders.join(top, ["o_custkey", "o_orderkey"], "left").select("o_custkey", "o_orderkey", F.explode(F.filter(named, lambda x: x.isNotNull())).alias("role"), c("o_orderkey").alias("place"), F.floor(c("o_totalprice") / 100000).alias("weight"), (c("o_orderkey") % 3).alias("priority"), c("o_orderdate").alias("date"))
    return remedies.key_documents(rows, "o_custkey", "o_orderkey")


@query("q_crawl", "X6 J6", """
    WITH n AS (SELECT CAST(max(ts) AS TIMESTAMP) AS t FROM events) SELECT event_id, event_type FROM events, n WHERE ts >= t - INTERVAL 3 DAY AND ts < t AND event_id NOT IN (SELECT doc_id FROM documents)""")
def crawl(t: Tables) -> DataFrame:
    newest = t.events.agg(F.max("ts").cast("timestamp").alias("_t"))
    recent = t.events.crossJoin(newest).where((F.col("ts") >= F.col("_t") - F.make_dt_interval(days=F.lit(3))) & (F.col("ts") < F.col("_t")))
    return joins.missing(recent.select("event_id", "event_type"), t.documents.select(F.col("doc_id").alias("event_id")), "event_id")
