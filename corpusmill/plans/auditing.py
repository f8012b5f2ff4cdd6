"""Queries on quality, scores and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.operators import graph, joins, quality, scoring
from corpusmill.plans.registry import Tables, query

_RULES = [(r"no such (view|table)", "db", "NO_SUCH_TABLE"), (r"^err(or)?", "app", "APP_ERROR"), (r"chase|buy", "shop", "SALE")]


@query("q_inspect", "", """
    WITH x AS (SELECT doc_id, length(text) < 300 AS a, quality IS NULL AS b, quality = 0 AS c, toxic = 1 AS d FROM documents LEFT JOIN labels USING (doc_id))
    SELECT doc_id, list_filter([CASE WHEN a THEN 'short' END, CASE WHEN b THEN 'unlabelled' END, CASE WHEN c THEN 'poor' END, CASE WHEN d THEN 'toxic' END], lambda v: v IS NOT NULL) AS issues,
        CASE WHEN coalesce(c, false)::INT + coalesce(d, false)::INT = 2 THEN 'critical' WHEN coalesce(c, false)::INT + coalesce(d, false)::INT = 1 THEN 'major' WHEN a OR b THEN 'minor' ELSE 'ok' END AS bucket FROM x""")
def inspect(t: Tables) -> DataFrame:
    return _inspected(t).select("doc_id", "issues", "bucket")


def _inspected(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.length("text").alias("n")).join(t.labels, "doc_id", "left")
    return quality.inspect(docs, {"short": F.col("n") < 300, "unlabelled": F.col("quality").isNull(), "poor": F.col("quality") == 0, "toxic": F.col("toxic") == 1}, ["poor", "toxic"])


@query("q_issue_summary", "Q2 A27", """
    WITH x AS (SELECT length(text) < 300 AS a, quality IS NULL AS b, quality = 0 AS c, toxic = 1 AS d FROM documents LEFT JOIN labels USING (doc_id)), y AS (SELECT 'short' AS issue, count(*) FILTER (WHERE a) AS n FROM x UNION ALL SELECT 'unlabelled', count(*) FILTER (WHERE b) FROM x UNION ALL SELECT 'poor', count(*) FILTER (WHERE c) FROM x UNION ALL SELECT 'toxic', count(*) FILTER (WHERE d) FROM x),
    z AS (SELECT issue, n, (SELECT count(*) FROM documents) AS m FROM y WHERE n > 0)
    SELECT issue, n, floor(n / m * 10000.0e0 + 0.5e0) / 10000.0e0 AS share, CAST(floor(n / m * 86000 + 0.5e0) AS BIGINT) AS estimate, CASE WHEN share >= 0.25 THEN 'high' WHEN share >= 0.1 THEN 'medium' ELSE 'low' END AS severity FROM z""")
def issue_summary(t: Tables) -> DataFrame:
    return quality.issue_summary(_inspected(t), 86_000)


@query("q_checks", "Q4 Q9", """
    SELECT 'order_without_lines' AS check_name, count(*) AS failing FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'line_without_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'unknown_status', count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F') UNION ALL SELECT 'shipped_before_ordered', count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate""")
def checks(t: Tables) -> DataFrame:
    orders, lines = t.orders.select(F.col("o_orderkey").alias("k"), "o_orderstatus", "o_orderdate"), t.lineitem.select(F.col("l_orderkey").alias("k"), "l_shipdate")
    return quality.checks({"order_without_lines": joins.missing(orders, lines, "k"), "line_without_order": joins.missing(lines, orders, "k"), "unknown_status": orders.where(~F.col("o_orderstatus").isin("O", "F")), "shipped_before_ordered": lines.join(orders, "k").where("l_shipdate < o_orderdate")})


@query("q_dedup", "Q5 U7", """
    WITH RECURSIVE w AS (SELECT DISTINCT unnest(string_split_regex(lower(strip_accents(text)), '[^a-z0-9]+')) AS t FROM benchmark), p AS (SELECT t, row_number() OVER (ORDER BY t) AS r FROM w WHERE length(t) >= 4),
    e AS (SELECT x.t AS a, y.t AS b FROM p x JOIN p y ON y.r - x.r BETWEEN 1 AND 39 WHERE regexp_replace(x.t, '[^0-9]', '', 'g') = regexp_replace(y.t, '[^0-9]', '', 'g') AND levenshtein(x.t, y.t) <= CASE WHEN least(length(x.t), length(y.t)) >= 15 THEN 3 WHEN least(length(x.t), length(y.t)) >= 8 THEN 2 ELSE 1 END),
    l AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), c AS (SELECT x, y FROM l UNION SELECT c.x, l.y FROM c JOIN l ON c.y = l.x)
    SELECT x AS term, arg_min(y, (length(y), y)) AS canonical FROM c GROUP BY 1""")
def dedup(t: Tables) -> DataFrame:
    words = t.benchmark.select(F.explode(tx.tokens(F.col("text"), 4)).alias("t"))
    return graph.representatives(joins.sorted_neighbours(words, "t"), "a", "b")


_TERMS = """
    WITH RECURSIVE t AS (SELECT DISTINCT unnest(string_split_regex(text, '[^a-zA-Z0-9]+')) AS term FROM benchmark), c AS (SELECT row_number() OVER (ORDER BY term) AS id, term, lower(term) AS norm FROM t WHERE length(term) >= 4),
    p AS (SELECT t, row_number() OVER (ORDER BY t) AS r FROM (SELECT DISTINCT norm AS t FROM c)),
    e AS (SELECT x.t AS a, y.t AS b FROM p x JOIN p y ON y.r - x.r BETWEEN 1 AND 39 WHERE regexp_replace(x.t, '[^0-9]', '', 'g') = regexp_replace(y.t, '[^0-9]', '', 'g') AND levenshtein(x.t, y.t) <= CASE WHEN least(length(x.t), length(y.t)) >= 15 THEN 3 WHEN least(length(x.t), length(y.t)) >= 8 THEN 2 ELSE 1 END),
    l AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), k AS (SELECT x, y FROM l UNION SELECT k.x, l.y FROM k JOIN l ON k.y = l.x), root AS (SELECT x, arg_min(y, (length(y), y)) AS root FROM k GROUP BY 1),
    m AS (SELECT id, term, coalesce(root, norm) AS root FROM c LEFT JOIN root ON x = norm), s AS (SELECT root, arg_min(id, (length(term), id)) AS master FROM m GROUP BY 1)"""


def _rewritten(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The benchmark's words as a catalog, and which items have them, after similar words became one."""
    words = t.benchmark.select("item_id", F.explode(F.split("text", "[^a-zA-Z0-9]+")).alias("term")).where("length(term) >= 4").distinct()
    catalog = joins.numbered(words.select("term").distinct(), [F.col("term")], "id")
    links = words.join(catalog, "term").select("item_id", F.col("id").alias("term_id"))
    pairs = joins.sorted_neighbours(catalog.select(tx.tag_norm(F.col("term")).alias("t")), "t")
    return graph.rewritten_terms(catalog, "id", "term", links, "item_id", "term_id", pairs)


@query("q_terms_rewritten", "Q5 U7", f"""{_TERMS} SELECT id, upper(root[1]) || root[2:] || '.' AS term FROM m JOIN s USING (root) WHERE id = master""")
def terms_rewritten(t: Tables) -> DataFrame:
    return _rewritten(t)[0].select("id", "term")


@query("q_links_repointed", "Q5", f"""{_TERMS} SELECT DISTINCT item_id, master AS term_id FROM (SELECT item_id, unnest(string_split_regex(text, '[^a-zA-Z0-9]+')) AS term FROM benchmark) JOIN m USING (term) JOIN s USING (root)""")
def links_repointed(t: Tables) -> DataFrame:
    return _rewritten(t)[1]


@query("q_catalog_backfill", "Q6 P3 A29", """
    WITH w AS (SELECT doc_id, trim(unnest(string_split(replace(text, chr(10), ' '), ' '))) AS raw FROM documents), v AS (SELECT doc_id, raw, lower(regexp_replace(raw, '[.\\s]+$', '')) AS norm FROM w)
    SELECT CASE WHEN norm = '' THEN 'empty' WHEN length(norm) < 3 THEN 'short' WHEN regexp_matches(norm, '[0-9]') THEN 'number' ELSE 'accepted' END AS verdict, count(*) AS n, count(DISTINCT norm) AS different FROM v GROUP BY 1""")
def catalog_backfill(t: Tables) -> DataFrame:
    raw = t.documents.select("doc_id", F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("raw")).withColumn("raw", F.trim("raw"))
    norm = F.lower(F.regexp_replace("raw", r"[.\s]+$", ""))
    return quality.catalog_backfill(raw, "doc_id", "raw", norm, {"empty": norm == "", "short": F.length(norm) < 3, "number": norm.rlike("[0-9]")})[1]


@query("q_guard", "", """
    WITH v AS (SELECT CASE WHEN p_size < 3 THEN 'empty' WHEN p_size < 10 THEN 'short' ELSE 'accepted' END AS verdict FROM part), c AS (SELECT verdict, count(*) AS n FROM v GROUP BY 1), s AS (SELECT verdict, n, floor(n / (SELECT count(*) FROM part) * 10000.0e0 + 0.5e0) / 10000.0e0 AS share FROM c)
    SELECT verdict, n, share, share <= CASE verdict WHEN 'empty' THEN 0.02 WHEN 'short' THEN 0.25 ELSE 1.0 END AS allowed FROM s""")
def guard(t: Tables) -> DataFrame:
    _, report = quality.catalog_backfill(t.part, "p_partkey", "p_name", F.lower("p_name"), {"empty": F.col("p_size") < 3, "short": F.col("p_size") < 10})
    return quality.guard(report, {"empty": 0.02, "short": 0.25})


@query("q_label_norm", "", """
    SELECT p_partkey, regexp_replace(trim(replace(p_name || '_x', '_', ' ')), '\\s+', ' ', 'g') AS label, contains(p_name || '_x', '_') AS changed FROM part""")
def label_norm(t: Tables) -> DataFrame:
    raw = F.concat("p_name", F.lit("_x"))
    label = tx.squeeze(F.replace(raw, F.lit("_"), F.lit(" ")))
    return t.part.select("p_partkey", label.alias("label"), (label != raw).alias("changed"))


@query("q_blockers", "", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'wait' WHEN o_totalprice > 300000 THEN 'review' ELSE 'go' END AS strategy, CASE WHEN o_orderstatus = 'P' THEN 'low' WHEN o_totalprice > 300000 THEN 'high' ELSE 'none' END AS risk FROM orders""")
def blockers(t: Tables) -> DataFrame:
    rule = F.when(F.col("o_orderstatus") == "P", F.struct(F.lit("wait").alias("s"), F.lit("low").alias("r"))).when(F.col("o_totalprice") > 300000, F.struct(F.lit("review").alias("s"), F.lit("high").alias("r"))).otherwise(F.struct(F.lit("go").alias("s"), F.lit("none").alias("r")))
    return t.orders.select("o_orderkey", rule.alias("x")).select("o_orderkey", F.col("x.s").alias("strategy"), F.col("x.r").alias("risk"))


@query("q_coherence_audit", "A14", """
    WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS r FROM c),
    x AS (SELECT o_custkey, CAST(sum(n) AS BIGINT) AS members, count(*) AS labels, max(n) FILTER (WHERE r = 1) AS a, coalesce(max(n) FILTER (WHERE r = 2), 0) AS b, count(*) FILTER (WHERE n = 1) AS s FROM r GROUP BY 1),
    y AS (SELECT o_custkey, members, labels, floor(a / members * 1000.0e0 + 0.5e0) / 1000.0e0 AS dominance, floor(b / a * 1000.0e0 + 0.5e0) / 1000.0e0 AS competition, floor(s / members * 1000.0e0 + 0.5e0) / 1000.0e0 AS outliers FROM x)
    SELECT *, CASE WHEN dominance >= 0.62 THEN 'coherent' WHEN dominance >= 0.5 AND outliers <= 0.3 THEN 'mostly_coherent' WHEN outliers > 0.34 THEN 'scattered' WHEN competition > 0.45 THEN 'contested' ELSE 'mixed' END AS status FROM y""")
def coherence_audit(t: Tables) -> DataFrame:
    return scoring.coherence(t.orders, "o_custkey", "o_orderpriority")


@query("q_validator", "Q16", "SELECT o_orderkey, CAST(greatest(0, 100 - (o_totalprice < 20000)::INT * 30 - (o_orderstatus = 'P')::INT * 25 - (o_orderpriority = '5-LOW')::INT * 60) AS INT) AS score FROM orders")
def validator(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", quality.validator_score({"cheap": (F.col("o_totalprice") < 20000, 30), "partial": (F.col("o_orderstatus") == "P", 25), "low": (F.col("o_orderpriority") == "5-LOW", 60)}).alias("score"))


@query("q_incidents", "P6", """
    SELECT event_id, CASE WHEN event_type IN ('view') THEN 'db' WHEN event_type = 'error' THEN 'app' WHEN event_type = 'purchase' THEN 'shop' ELSE 'unknown' END AS system, CASE WHEN event_type = 'view' THEN 'NO_SUCH_TABLE' WHEN event_type = 'error' THEN 'APP_ERROR' WHEN event_type = 'purchase' THEN 'SALE' ELSE 'UNKNOWN' END AS code,
        CASE WHEN event_type = 'view' THEN 'view' WHEN event_type = 'error' THEN 'or' END AS named FROM events""")
def incidents(t: Tables) -> DataFrame:
    message = F.when(F.col("event_type") == "view", "no such view: x").otherwise(F.col("event_type"))
    return quality.incidents(t.events.select("event_id", message.alias("m")), "m", _RULES).drop("m")


@query("q_router", "Q18", """
    SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'ui' WHEN event_type LIKE '%u%' THEN 'account' END AS handler FROM events""")
def router(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame([(1, "^(view|click)$", "ui"), (2, "u", "account"), (3, "^view", "never")], "ordinal int, pattern string, handler string")
    return quality.routed(t.events.select("event_id", "event_type"), "event_type", rules).select("event_id", "handler")


@query("q_event_dedup", "Q19 X3", """
    WITH RECURSIVE e AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
    w AS (SELECT *, ts AS last, true AS keep FROM e WHERE n = 1 UNION ALL SELECT e.*, CASE WHEN e.ts - w.last >= INTERVAL 120 SECOND THEN e.ts ELSE w.last END, e.ts - w.last >= INTERVAL 120 SECOND FROM w JOIN e ON e.user_id IS NOT DISTINCT FROM w.user_id AND e.event_type IS NOT DISTINCT FROM w.event_type AND e.n = w.n + 1)
    SELECT user_id, event_type, ts, event_id FROM w WHERE keep""")
def event_dedup(t: Tables) -> DataFrame:
    return quality.without_repeats(t.events, ["user_id", "event_type"], "ts", "event_id", 120)


@query("q_recovered", "", "SELECT DISTINCT doc_id, 'item ' || (doc_id % 10) AS tag FROM documents")
def recovered(t: Tables) -> DataFrame:
    tags = F.to_json(F.array(F.lit("plain"), F.concat(F.lit(" Item "), (F.col("doc_id") % 10).cast("string"))))
    return quality.recovered_tags(t.documents.select("doc_id", tags.alias("j")), "doc_id", "j")


def _scored(t: Tables) -> DataFrame:
    """Orders as documents: lines are relations, return flags say which."""
    f = F.col("l_returnflag")
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("in_total"), F.count_if(f == "A").alias("in_strengthens"), F.count_if(f == "N").alias("in_develops"), F.count_if(f == "R").alias("in_displaces"), F.count_if(F.col("l_linestatus") == "F").alias("out_total"))
    o = t.orders.select(F.col("o_orderkey").alias("id"), F.floor(F.greatest(F.lit(0.0), 1 - F.datediff(F.lit("1998-08-02").cast("date"), "o_orderdate") / 2191.5) * 1000.0 + 0.5).alias("r"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("relevant"), (F.col("o_orderstatus") == "F").cast("int").alias("bulletin"), (F.col("o_orderstatus") == "P").cast("int").alias("abstained"))
    zero = {c: F.lit(0) for c in ("in_limits", "in_adjusts", "out_displaces", "reactivated", "clarified")}
    df = lines.join(o, "id").withColumns(zero).withColumn("recency", F.least(F.lit(1.0), F.col("r") / 1000.0)).withColumn("topic", F.lit(1)).withColumn("sources", (F.col("in_total") > 2).cast("int"))
    return scoring.document_scores(df)


_SCORES = """
    x AS (SELECT o_orderkey AS id, count(*) AS tin, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'N') AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS d, count(*) FILTER (WHERE l_linestatus = 'F') AS tout,
        least(1.0e0, floor(greatest(0.0e0, 1 - date_diff('day', o_orderdate, TIMESTAMP '1998-08-02') / 2191.5e0) * 1000.0e0 + 0.5e0) / 1000.0e0) AS rec, (o_orderpriority = '1-URGENT')::INT AS rel, (o_orderstatus = 'F')::INT AS bul, (o_orderstatus = 'P')::INT AS abst
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate, o_orderpriority, o_orderstatus),
    y AS (SELECT *, least(1.0e0, (tin + tout) / 8) AS deg, (tin > 2)::INT AS src FROM x),
    z AS (SELECT id, d, abst, rec * 0.36e0 + rel * 0.16e0 + CASE WHEN a > 0 THEN 1.0e0 ELSE 0.0e0 END * 0.15e0 + 0 * 0.12e0 + CASE WHEN n > 0 THEN 1.0e0 ELSE 0.0e0 END * 0.04e0 - least(0.26e0, d * 0.09e0) - abst * 0.04e0 AS cur,
        deg * 0.22e0 + rel * 0.16e0 + bul * 0.10e0 + least(0.28e0, tin * 0.07e0) + least(0.14e0, d * 0.14e0) + least(0.10e0, 0 * 0.08e0) + (1 - rec) * 0.12e0 AS his, deg * 0.25e0 + rel * 0.18e0 + bul * 0.09e0 + src * 0.08e0 + least(0.18e0, tin * 0.05e0) + least(0.14e0, tout * 0.04e0) AS cen FROM y),
    s AS (SELECT id, d, abst, floor(greatest(0.0e0, least(1.0e0, cur)) * 1000.0e0 + 0.5e0) / 1000.0e0 AS currentness, floor(greatest(0.0e0, least(1.0e0, his)) * 1000.0e0 + 0.5e0) / 1000.0e0 AS historical, floor(greatest(0.0e0, least(1.0e0, cen)) * 1000.0e0 + 0.5e0) / 1000.0e0 AS centrality FROM z)"""


@query("q_metadata", "", f"WITH {_SCORES} SELECT id, currentness, historical, centrality, currentness >= 0.58e0 AND abst = 0 AND d <= 1 AS supports FROM s")
def metadata(t: Tables) -> DataFrame:
    return _scored(t).select("id", "currentness", "historical", "centrality", "supports")


@query("q_seeds", "", f"WITH {_SCORES} SELECT id, centrality, currentness FROM s WHERE centrality >= 0.7e0 ORDER BY centrality DESC, currentness DESC, id LIMIT 25")
def seeds(t: Tables) -> DataFrame:
    return scoring.seeds(_scored(t), ["core"], 0.7, 25, "id").select("id", "centrality", "currentness")


@query("q_evidence", "", """
    SELECT doc_id, 'license' AS kind, CAST(1.0 AS DOUBLE) AS weight FROM documents WHERE contains(lower(text), 'apache license') UNION ALL SELECT doc_id, 'length', CAST(n_chars / 1000 AS DOUBLE) FROM documents WHERE n_chars > 5000""")
def evidence(t: Tables) -> DataFrame:
    signals = F.size(scoring.text_signals(F.col("text"), ["apache license"]))
    docs = t.documents.select("doc_id", "n_chars", signals.alias("s"))
    return scoring.evidence(docs, "doc_id", {"license": (F.col("s") > 0, F.lit(1.0)), "length": (F.col("n_chars") > 5000, F.col("n_chars") / 1000)})


@query("q_merge_llm", "", """
    SELECT doc_id, CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'good' WHEN n_chars > 2000 THEN 'long' ELSE 'plain' END AS label FROM documents LEFT JOIN labels USING (doc_id)""")
def merge_llm(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.when(F.col("n_chars") > 2000, "long").otherwise("plain").alias("rule")).join(t.labels.select("doc_id", "toxic", F.when(F.col("quality") == 1, "good").alias("model")), "doc_id", "left")
    return docs.select("doc_id", scoring.merged_labels(docs, "model", "rule", [(F.col("toxic") == 1, "reject")]).alias("label"))


def _walk(pick: str, gated: bool) -> str:
    """Clusters by recursion over the seeds of each label: what a seed takes of the rows that aren't used yet."""
    gate, weak = ("least(1.0e0, o_totalprice / 500000.0e0) >= 0.28 OR o_custkey % 5 = 0 OR o_custkey % 10 = 2", "o_totalprice / 500000.0e0 < 0.22 AND o_custkey % 5 <> 0 AND o_custkey % 10 <> 2") if gated else ("true", "false")
    return f"""
        WITH RECURSIVE g AS (SELECT l_orderkey AS k, list(DISTINCT l_suppkey) AS tags, list(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY 1),
        c AS (SELECT o_custkey AS l, o_orderkey AS k, tags, flags, (o_orderpriority = '1-URGENT')::INT AS near, o_totalprice / 500000.0e0 AS align, {gate} AS passes, {weak} AS weak, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders JOIN g ON k = o_orderkey WHERE o_orderstatus IN ('O', 'F')),
        d AS (SELECT * FROM c WHERE r <= 120),
        p AS (SELECT a.l, a.r AS i, b.r AS j, b.k, len(list_intersect(a.tags, b.tags)) AS s, 2 + least(2 * s, 6) + least(len(list_intersect(a.flags, b.flags)), 3) + 3 * b.near + least(4 * b.align, 4.0e0) AS value, b.near FROM d a JOIN d b ON a.l = b.l AND a.r <> b.r WHERE b.passes AND NOT a.weak),
        f AS (SELECT l, i, list({{'j': j, 'k': k, 'value': CAST(value AS DOUBLE)}} ORDER BY {pick}) AS c FROM p WHERE value >= 5 AND (s > 0 OR near > 0) GROUP BY 1, 2),
        w AS (SELECT l, 0 AS i, CAST([] AS BIGINT[]) AS used, CAST([] AS STRUCT(j BIGINT, k BIGINT, value DOUBLE)[]) AS taken FROM d GROUP BY l
            UNION ALL SELECT w.l, w.i + 1, list_concat(list_append(w.used, w.i + 1), list_transform(t.t, lambda x: x.j)), t.t FROM w JOIN (SELECT l, max(r) AS n FROM d GROUP BY 1) n ON n.l = w.l AND w.i < n.n LEFT JOIN f ON f.l = w.l AND f.i = w.i + 1,
                LATERAL (SELECT CASE WHEN list_contains(w.used, w.i + 1) THEN [] ELSE list_filter(coalesce(f.c, []), lambda x: NOT list_contains(w.used, x.j))[1:7] END AS t) t),
        o AS (SELECT w.l, d.k AS seed, w.taken FROM w JOIN d ON d.l = w.l AND d.r = w.i WHERE len(taken) > 0)
        SELECT l AS o_custkey, seed, seed AS member, 0.0e0 AS score FROM o UNION ALL SELECT l, seed, t.k, t.value FROM (SELECT l, seed, unnest(taken) AS t FROM o)"""


def _candidates(t: Tables) -> DataFrame:
    tags = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("tags"), F.collect_set("l_returnflag").alias("flags"))
    return t.orders.where("o_orderstatus IN ('O', 'F')").withColumn("near", (F.col("o_orderpriority") == "1-URGENT").cast("int")).withColumn("align", F.col("o_totalprice") / 500000.0).join(tags, "o_orderkey")


@query("q_clusters", "C2", _walk("-value, k", False))
def clusters(t: Tables) -> DataFrame:
    return scoring.greedy_clusters(_candidates(t), "o_custkey", "o_orderkey", "tags", "flags", "near", "align", "o_orderdate")


@query("q_clusters_for_query", "C2", _walk("j", True))
def clusters_for_query(t: Tables) -> DataFrame:
    """With the gate of a query: alignment by price, retrieval and words by customer; members newest first."""
    m = F.col("o_custkey")
    passes, weak = scoring.query_gate(F.col("align"), F.when(m % 5 == 0, 0.9).otherwise(0.1), F.when(m % 10 == 2, 1).otherwise(0), F.lit(1), F.lit(3))
    return scoring.greedy_clusters(_candidates(t), "o_custkey", "o_orderkey", "tags", "flags", "near", "align", "o_orderdate", passes=passes, weak=weak, in_order=True)


@query("q_cluster_candidates", "C1 A14", """
    WITH r AS (SELECT p_partkey, CASE WHEN p_size > 3 THEN p_type ELSE ' ' END AS label, p_retailprice FROM part), n AS (SELECT p_partkey, coalesce(nullif(trim(label), ''), 'Sin materia') AS label, p_retailprice FROM r)
    SELECT p_partkey, label FROM n WHERE label = (SELECT label FROM n GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1) ORDER BY p_retailprice DESC, p_partkey LIMIT 120""")
def cluster_candidates(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.when(F.col("p_size") > 3, F.col("p_type")).otherwise(" ").alias("label"), "p_retailprice")
    return scoring.dominant_rows(rows, "label", "p_retailprice", "p_partkey", 120).select("p_partkey", "label")


@query("q_pairwise", "C9", """
    SELECT o_orderkey, floor(greatest(0.0e0, least(1.0e0, (o_orderstatus = 'F')::INT * 0.40e0 + (o_orderstatus = 'P')::INT * 0.25e0 + o_totalprice / 600000.0e0 * 0.20e0 + 0.5e0 * 0.15e0)) * 1000.0e0 + 0.5e0) / 1000.0e0 AS risk FROM orders""")
def pairwise(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    return t.orders.select("o_orderkey", scoring.change_risk((s == "F").cast("int"), (s == "P").cast("int"), F.col("o_totalprice") / 600000.0, F.lit(0.5)).alias("risk"))


@query("q_line_merge", "C19", """
    WITH l AS (SELECT p_brand AS line, count(*) AS members, count(DISTINCT p_type) AS sources, CAST(avg(p_size) / 50 AS DECIMAL(18,3)) AS coherence, max(p_size) AS level FROM part GROUP BY 1), m AS (SELECT CASE WHEN line IN ('Brand#12', 'Brand#13') THEN 'Brand#11' ELSE line END AS line, members, sources, coherence, level FROM l)
    SELECT line, CAST(sum(members) AS BIGINT) AS members, CAST(sum(sources) AS BIGINT) AS sources, count(*) AS merged, floor((CAST(sum(CAST(CAST(coherence AS DOUBLE) * members AS DECIMAL(18,4))) AS DOUBLE) / sum(members) - CASE WHEN count(*) > 1 THEN 0.08e0 ELSE 0.0e0 END) * 1000.0e0 + 0.5e0) / 1000.0e0 AS coherence, max(level) AS level FROM m GROUP BY 1""")
def line_merge(t: Tables) -> DataFrame:
    lines = t.part.groupBy(F.col("p_brand").alias("line")).agg(F.count("*").alias("members"), F.count_distinct("p_type").alias("sources"), (F.avg("p_size") / 50).cast("decimal(18,3)").cast("double").alias("coherence"), F.max("p_size").alias("level"))
    override = t.spark.createDataFrame([("Brand#12", "Brand#11"), ("Brand#13", "Brand#11")], "from_line string, to_line string")
    return scoring.merged_lines(lines.withColumnRenamed("line", "name"), override, "name")


@query("q_rate_windows", "X2", """
    SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n, count(*) > 20 AS over_limit FROM events GROUP BY 1, 2""")
def rate_windows(t: Tables) -> DataFrame:
    from corpusmill.streaming.events import rates

    return rates(t.events, "ts", "event_type", "1 day", 20)


@query("q_minute_limits", "X1", """
    SELECT user_id, time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, count(*) AS n, count(*) > 1 AS over_limit FROM events GROUP BY 1, 2""")
def minute_limits(t: Tables) -> DataFrame:
    from corpusmill.streaming.events import rates

    return rates(t.events, "ts", "user_id", "1 minute", 1)


@query("q_key_pool", "", """
    SELECT arg_min(s_suppkey, (s_acctbal, s_suppkey)) AS key, s_nationkey FROM supplier WHERE s_acctbal > 0 GROUP BY s_nationkey""")
def key_pool(t: Tables) -> DataFrame:
    free = t.supplier.where("s_acctbal > 0")
    return joins.best_per_key(free, ["s_nationkey"], [F.col("s_acctbal"), F.col("s_suppkey")]).select(F.col("s_suppkey").alias("key"), "s_nationkey")


@query("q_sorted_rank", "W5 O6", "SELECT s_suppkey, CAST(dense_rank() OVER (ORDER BY s_nationkey) AS INT) AS place FROM supplier")
def sorted_rank(t: Tables) -> DataFrame:
    nations = joins.numbered(t.supplier.select("s_nationkey").distinct(), [F.col("s_nationkey")], "place")
    return t.supplier.join(nations, "s_nationkey").select("s_suppkey", F.col("place").cast("int").alias("place"))
