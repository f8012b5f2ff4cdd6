"""Queries on clusters. A customer's orders are a cluster; suppliers are tags, parts sources, flags and statuses of lines their flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import clusters
from corpusmill.plans.registry import Tables, query
from corpusmill.sources.tables import dealt

AS_OF = "1998-08-02 00:00:00"


def _members(t: Tables, parts: int | None = None) -> DataFrame:
    flag = F.col("l_returnflag")
    lines = dealt(t.lineitem, parts, "l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.collect_set(F.col("l_suppkey") % 20).alias("tags"), F.collect_set(F.col("l_partkey") % 50).alias("sources"), F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("flags"), F.count("*").alias("relations"), F.count_if(flag == "A").alias("in_strengthens"),
        F.count_if(flag == "N").alias("in_develops"), F.count_if((flag == "R") & (F.col("l_discount") < 0.05)).alias("in_adjusts"), F.count_if((flag == "R") & F.col("l_discount").between(0.05, 0.08)).alias("in_limits"), F.count_if((flag == "R") & (F.col("l_discount") > 0.08)).alias("in_displaces"), F.max("l_shipdate").alias("latest_in"),
    )
    orders = t.orders.select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("ts"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("neighbour"), (F.col("o_totalprice") / 500000.0).alias("align"), F.when(F.col("o_orderstatus") == "P", 0.5).otherwise(0.0).alias("update"))
    counts = ["relations", "in_strengthens", "in_develops", "in_adjusts", "in_limits", "in_displaces"]
    return orders.join(lines, "o_orderkey", "left").fillna(0, counts)


def _shared(name: str, item: str) -> str:
    return f"""d{name} AS (SELECT DISTINCT o_custkey AS c, o_orderkey AS k, {item} AS i FROM lineitem JOIN orders ON o_orderkey = l_orderkey), f{name} AS (SELECT c, i, count(*) - 1 AS n FROM d{name} GROUP BY 1, 2),
    s{name} AS (SELECT c, k, CAST(sum(n) AS BIGINT) AS {name} FROM d{name} JOIN f{name} USING (c, i) GROUP BY 1, 2)"""


_R = "l_returnflag = 'R' AND l_discount"
_INFLUENCE = f"""
    {_shared("tags", "l_suppkey % 20")}, {_shared("sources", "l_partkey % 50")}, {_shared("flags", "l_returnflag || l_linestatus")},
    l AS (SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'A') AS st, count(*) FILTER (WHERE l_returnflag = 'N') AS dv, count(*) FILTER (WHERE {_R} < 0.05e0) AS ad, count(*) FILTER (WHERE {_R} BETWEEN 0.05e0 AND 0.08e0) AS li, count(*) FILTER (WHERE {_R} > 0.08e0) AS di, max(l_shipdate) AS latest FROM lineitem GROUP BY 1),
    o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderdate AS ts, (o_orderpriority = '1-URGENT')::INT::DOUBLE AS near, greatest(0.0e0, least(1.0e0, o_totalprice / 500000.0e0)) AS al, CASE WHEN o_orderstatus = 'P' THEN 0.5e0 ELSE 0.0e0 END AS up, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS place FROM orders),
    g AS (SELECT c, count(*) AS many, epoch(min(ts)) AS lo, epoch(max(ts)) AS hi FROM o GROUP BY 1), md AS (SELECT o.c, epoch(ts) AS med FROM o JOIN g ON o.c = g.c AND place = many // 2),
    p AS (SELECT o.c, o.k, o.ts, many, near, al, up, least(1.0e0, coalesce(tags, 0) / greatest((many - 1) * 2, 1)) AS tg, least(1.0e0, coalesce(flags, 0) / greatest((many - 1) * 2, 1)) AS fl, least(1.0e0, coalesce(sources, 0) / greatest(many - 1, 1)) AS so,
        least(1.0e0, coalesce(n, 0) / 3.0e0) AS re, 1 - least(1.0e0, abs(epoch(o.ts) - med) / greatest(hi - lo, 1.0e0)) AS te, CASE WHEN hi > lo THEN greatest(0.0e0, least(1.0e0, (epoch(o.ts) - lo) / (hi - lo))) ELSE 0.5e0 END AS rc,
        least(1.0e0, (coalesce(st, 0) + coalesce(dv, 0) * 0.65e0) / 3) AS la, least(1.0e0, (coalesce(li, 0) * 0.8e0 + coalesce(di, 0) * 1.2e0 + coalesce(ad, 0) * 0.45e0) / 2) AS ob, coalesce((latest > o.ts)::INT::DOUBLE, 0.0e0) AS ac
        FROM o JOIN g ON g.c = o.c JOIN md ON md.c = o.c LEFT JOIN l ON l.k = o.k LEFT JOIN stags a ON a.k = o.k LEFT JOIN ssources b ON b.k = o.k LEFT JOIN sflags e ON e.k = o.k),
    q AS (SELECT *, tg * 0.3e0 + so * 0.2e0 + near * 0.16e0 + fl * 0.1e0 + re * 0.1e0 + te * 0.05e0 + up * 0.12e0 + al * 0.24e0 AS score FROM p),
    s AS (SELECT *, greatest(0.0e0, least(1.0e0, score * 0.44e0 + rc * 0.2e0 + la * 0.16e0 + re * 0.08e0 + ac * 0.06e0 + up * 0.14e0 + al * 0.18e0 + ob * -0.2e0)) AS priority FROM q)"""


@query("q_influence", "C5 C6", f"WITH {_INFLUENCE} SELECT k AS o_orderkey, floor(score * 1000.0e0 + 0.5e0) / 1000.0e0 AS score, floor(priority * 1000.0e0 + 0.5e0) / 1000.0e0 AS priority FROM s")
def influence(t: Tables) -> DataFrame:
    parts = t.parts("lineitem")
    scored = clusters.influence(_members(t, parts), "o_custkey", "o_orderkey", parts)
    return scored.select("o_orderkey", clusters.half_up(F.col("score"), 3).alias("score"), clusters.half_up(F.col("priority"), 3).alias("priority"))


@query("q_cores", "C7 C8", f"""
    WITH {_INFLUENCE}, w AS (SELECT c, count(*) AS members, CAST(sum(CAST(score AS DECIMAL(20,10))) AS DOUBLE) / count(*) AS density, max(priority) AS top, min(ts) AS a, max(ts) AS b FROM s GROUP BY 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY priority DESC, score DESC, k) AS r FROM s), i AS (SELECT c, list(k ORDER BY r) AS influential FROM r WHERE r <= 3 GROUP BY 1),
    core AS (SELECT s.c, least(count(*), 2) AS core FROM s JOIN w ON s.c = w.c WHERE priority >= greatest(density, top * 0.78e0) AND re >= 0.34e0 AND so >= 0.25e0 AND te >= 0.2e0 AND ob < 0.8e0 GROUP BY 1),
    n AS (SELECT c, max(n) + 1 AS n FROM fsources GROUP BY 1),
    x AS (SELECT w.*, influential, coalesce(core, 0) AS core, coalesce(n, 0) AS n, (epoch(b) - epoch(a)) / 86400.0e0 AS days FROM w JOIN i ON i.c = w.c LEFT JOIN core ON core.c = w.c LEFT JOIN n ON n.c = w.c)
    SELECT c AS o_custkey, members, floor(density * 1000.0e0 + 0.5e0) / 1000.0e0 AS density, influential[1] AS representative, influential, CAST(core AS BIGINT) AS core,
        floor((density * 0.45e0 + least(1.0e0, log2(members + 1) / 3) * 0.2e0 + least(1.0e0, core / 2) * 0.15e0 + least(1.0e0, n / members) * 0.15e0 + CASE WHEN days <= 0 THEN 0.2e0 ELSE least(1.0e0, days / 365) END * 0.05e0) * 1000.0e0 + 0.5e0) / 1000.0e0 AS importance FROM x""")
def cores(t: Tables) -> DataFrame:
    parts = t.parts("lineitem")
    return clusters.cores(clusters.influence(_members(t, parts), "o_custkey", "o_orderkey", parts), "o_custkey", "o_orderkey")


@query("q_cluster_state", "C11 C12 C14 C16", f"""
    WITH x AS (SELECT l_orderkey, o_orderstatus, count(*) FILTER (WHERE l_returnflag = 'A') AS st, count(*) FILTER (WHERE l_returnflag = 'N' AND l_tax > 0.04e0) AS dv, count(*) FILTER (WHERE {_R} < 0.03e0) AS ad, count(*) FILTER (WHERE {_R} BETWEEN 0.03e0 AND 0.06e0) AS li, count(*) FILTER (WHERE {_R} > 0.06e0) AS di,
        max(l_shipdate) AS latest, max(l_shipdate) FILTER (WHERE {_R} > 0.06e0) AS piv, floor((epoch(max(l_shipdate)) - epoch(min(l_shipdate))) / 86400.0e0 / 365.25e0) AS years, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
    y AS (SELECT *, ad + li + di AS un, least(1.0e0, (di * 2 + li) / n * 0.5e0) AS risk, CASE WHEN o_orderstatus = 'P' THEN 'fragmented' WHEN di > 0 OR li >= 2 THEN 'in_review' WHEN ad + li + di >= greatest(st, 1) * 0.35e0 THEN 'strained' WHEN dv > 0 OR ad > 0 OR years >= 3 THEN 'evolving' ELSE 'stable' END AS status,
        greatest(0.0e0, least(1.0e0, 1 - (epoch(TIMESTAMP '{AS_OF}') - epoch(latest)) / 86400.0e0 / (365.25e0 * 4))) AS r1, greatest(0.0e0, least(1.0e0, 1 - (epoch(TIMESTAMP '{AS_OF}') - epoch(piv)) / 86400.0e0 / (365.25e0 * 4))) AS r2 FROM x)
    SELECT l_orderkey, CASE WHEN greatest(st, dv, un) = 0 THEN NULL WHEN st >= greatest(dv, un) THEN 'strengthens' WHEN dv >= un THEN 'develops' ELSE 'adjusts' END AS dominant, status,
        CASE WHEN risk >= 0.72e0 OR un >= 2 OR di > 0 THEN 'under_tension' WHEN risk >= 0.38e0 OR years >= 3 OR st < 2 THEN 'evolving' ELSE 'settled' END AS state,
        floor(least(1.0e0, floor(r1 * 1000.0e0 + 0.5e0) / 1000.0e0 * 0.4e0 + CASE WHEN piv IS NULL THEN 0.0e0 ELSE floor(r2 * 1000.0e0 + 0.5e0) / 1000.0e0 END * 0.15e0 + CASE status WHEN 'stable' THEN 0.08e0 WHEN 'evolving' THEN 0.45e0 WHEN 'fragmented' THEN 0.62e0 WHEN 'strained' THEN 0.78e0 ELSE 1.0e0 END * 0.3e0 + least(1.0e0, (ad + li + di * 1.4e0 + un * 0.35e0) / 4) * 0.15e0) * 1000.0e0 + 0.5e0) / 1000.0e0 AS active FROM y""")
def cluster_state(t: Tables) -> DataFrame:
    flag, low = F.col("l_returnflag"), F.col("l_discount")
    displaced = (flag == "R") & (low > 0.06)
    rows = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey").groupBy("l_orderkey", "o_orderstatus").agg(
        F.count_if(flag == "A").alias("in_strengthens"), F.count_if((flag == "N") & (F.col("l_tax") > 0.04)).alias("in_develops"), F.count_if((flag == "R") & (low < 0.03)).alias("in_adjusts"), F.count_if((flag == "R") & low.between(0.03, 0.06)).alias("in_limits"), F.count_if(displaced).alias("in_displaces"),
        F.max("l_shipdate").alias("latest"), F.max(F.when(displaced, F.col("l_shipdate"))).alias("pivot"), F.floor((F.unix_timestamp(F.max("l_shipdate")) - F.unix_timestamp(F.min("l_shipdate"))) / 86400.0 / 365.25).alias("years"), F.count("*").alias("n"),
    )
    c = F.col
    unrest, risk = c("in_adjusts") + c("in_limits") + c("in_displaces"), F.least(F.lit(1.0), (c("in_displaces") * 2 + c("in_limits")) / c("n") * 0.5)
    status = clusters.graph_status(c("o_orderstatus") == "P", c("years"))
    return rows.select("l_orderkey", clusters.dominant_bucket(c("in_strengthens"), c("in_develops"), unrest).alias("dominant"), status.alias("status"), clusters.doctrinal_state(risk, F.lit(False), c("years"), c("in_strengthens")).alias("state"), clusters.active_signal(status, c("latest"), c("pivot"), F.lit(AS_OF).cast("timestamp")).alias("active"))


@query("q_update_signal", "C4", """
    SELECT doc_id, floor(least(1.0e0, ({terms}) / 4) * 1000.0e0 + 0.5e0) / 1000.0e0 AS signal
    FROM (SELECT doc_id, lower(source) || CASE WHEN lang = 'en' THEN ' la corte suprema reconsidera' WHEN lang = 'fr' THEN ' litigios judiciales que el tribunal unifica: revision' WHEN lang = 'es' THEN ' modificacion' ELSE '' END AS x FROM documents)""".replace("{terms}", " + ".join(f"contains(x, '{w}')::INT" for w in clusters.UPDATE_WORDS)))
def update_signal(t: Tables) -> DataFrame:
    said = F.when(F.col("lang") == "en", " La Corte Suprema RECONSIDERA").when(F.col("lang") == "fr", " Litigios judiciales que el tribunal unifica: revisión").when(F.col("lang") == "es", " Modificación").otherwise("")
    return t.documents.select("doc_id", clusters.update_signal(F.concat(F.coalesce("source", F.lit("")), said)).alias("signal"))


_TERMS = ["apache", "mit license", "rights reserved", "gnu general", "cc by"]


@query("q_intent_boost", "V7", f"""
    WITH x AS (SELECT doc_id, trim(regexp_replace(regexp_replace(translate(lower(text), 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿ', 'aaaaaaeeeeiiiiooooouuuuncyy'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM documents),
    y AS (SELECT doc_id, contains(t, 'license') AS l, {" + ".join(f"contains(t, '{w}')::INT" for w in _TERMS)} AS n FROM x)
    SELECT doc_id, CASE WHEN l OR n > 0 THEN floor((CASE WHEN l THEN 0.18e0 ELSE 0.08e0 END + least(0.14e0, n * 0.04e0)) * 0.75e0 * 100.0e0 + 0.5e0) / 100.0e0 ELSE 0.0e0 END AS boost FROM y""")
def intent_boost(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", clusters.intent_boost(F.col("text"), "License", _TERMS, F.lit(0.75)).alias("boost"))


@query("q_cluster_total", "V11", """
    WITH h AS (SELECT o_custkey AS c, o_orderkey AS k, CASE o_orderpriority WHEN '1-URGENT' THEN 1.9e0 WHEN '2-HIGH' THEN 1.35e0 ELSE 0.8e0 END AS w, (o_orderpriority = '1-URGENT')::INT AS rep, o_totalprice / 600000.0e0 AS norm FROM orders WHERE o_orderstatus <> 'P'),
    f AS (SELECT c, CAST(sum(CAST(norm * w AS DECIMAL(20,8))) AS DOUBLE) AS m, max(norm) AS pk, max(rep) AS rep FROM h GROUP BY 1), b AS (SELECT c AS best, c_mktsegment AS seg FROM (SELECT c FROM h ORDER BY norm DESC, k LIMIT 1) JOIN customer ON c_custkey = c),
    x AS (SELECT c_custkey, c_nationkey AS n, coalesce(m, 0.0e0) AS m, coalesce(pk, 0.0e0) AS pk, coalesce(rep, 0) AS rep, coalesce((c_custkey = best)::INT, 0) AS own, coalesce((c_mktsegment = seg)::INT, 0) AS mat, c_acctbal FROM customer LEFT JOIN f ON c = c_custkey LEFT JOIN b ON true)
    SELECT c_custkey, floor((m * 2.1e0 + pk * 1.8e0 + rep * 0.8e0 + own * 2.6e0 + mat * 1.3e0 + n / 25.0e0 * 0.35e0 + (n % 2) * 0.25e0 + n / 30.0e0 * 3.4e0 + (n % 4) / 10.0e0 * 3.2e0 + (n % 3) / 10.0e0 * 4.6e0 + (n % 7) / 7.0e0 * 1.0e0 + (n % 6) / 6.0e0 * 0.75e0
        + CASE n % 3 WHEN 0 THEN 0.35e0 WHEN 1 THEN 0.2e0 ELSE 0.0e0 END - (CASE WHEN n % 5 <= 1 AND 3 + n % 2 >= 3 THEN 2.4e0 ELSE 0.0e0 END + CASE WHEN n > 10 AND n % 3 = 0 AND own = 0 THEN 1.15e0 ELSE 0.0e0 END)) * 1000.0e0 + 0.5e0) / 1000.0e0 AS total FROM x""")
def cluster_total(t: Tables) -> DataFrame:
    role = F.when(F.col("o_orderpriority") == "1-URGENT", "representative").when(F.col("o_orderpriority") == "2-HIGH", "core").otherwise("supporting")
    hits = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", role.alias("role"), (F.col("o_totalprice") / 600000.0).alias("norm"))
    n = F.col("c_nationkey")
    status = F.when(n % 3 == 0, "in_review").when(n % 3 == 1, "strained").otherwise("stable")
    lines = t.customer.select(
        "c_custkey", F.col("c_mktsegment").alias("matter"), (n / 25.0).alias("affinity"), (n % 2).alias("own_matter"), (n / 30.0).alias("coverage"), (n % 5).alias("matched"), (n % 2 + 3).alias("asked"), (n % 4 / 10.0).alias("intent"), (n % 3 / 10.0).alias("subtopic"), (n > 10).alias("subtopic_asked"),
        (n % 7 / 7.0).alias("importance"), (n % 6 / 6.0).alias("active"), status.alias("status"),
    )
    return clusters.cluster_totals(hits, lines, "c_custkey", "o_orderkey")


@query("q_title_pairs", "J20", """
    WITH g AS (SELECT DISTINCT p_partkey AS k, trim(lower(p_name)) || ' ' || p_size AS t, l_suppkey % 40 AS i FROM part JOIN lineitem ON l_partkey = p_partkey), s AS (SELECT DISTINCT p_partkey AS k, trim(lower(p_name)) || ' ' || p_size AS t, l_linenumber AS i FROM part JOIN lineitem ON l_partkey = p_partkey),
    gn AS (SELECT k, count(*) AS n FROM g GROUP BY 1), sn AS (SELECT k, count(*) AS n FROM s GROUP BY 1),
    gp AS (SELECT x.k AS a, y.k AS b, count(*) AS c FROM g x JOIN g y ON x.t = y.t AND x.i = y.i AND x.k < y.k GROUP BY 1, 2), sp AS (SELECT x.k AS a, y.k AS b, count(*) AS c FROM s x JOIN s y ON x.t = y.t AND x.i = y.i AND x.k < y.k GROUP BY 1, 2),
    p AS (SELECT coalesce(gp.a, sp.a) AS a, coalesce(gp.b, sp.b) AS b, coalesce(gp.c, 0) AS gc, coalesce(sp.c, 0) AS sc FROM gp FULL JOIN sp ON gp.a = sp.a AND gp.b = sp.b),
    o AS (SELECT a, b, gc / least(x.n, y.n) AS g, sc / least(z.n, w.n) AS s FROM p JOIN gn x ON x.k = a JOIN gn y ON y.k = b JOIN sn z ON z.k = a JOIN sn w ON w.k = b)
    SELECT a, b, floor(g * 10000.0e0 + 0.5e0) / 10000.0e0 AS tags, floor(s * 10000.0e0 + 0.5e0) / 10000.0e0 AS sources, floor((0.7e0 + g * 0.18e0 + s * 0.12e0) * 100.0e0 + 0.5e0) / 100.0e0 AS confidence, CASE WHEN greatest(g, s) >= 0.55 THEN 'low' ELSE 'medium' END AS risk FROM o WHERE greatest(g, s) >= 0.4""")
def title_pairs(t: Tables) -> DataFrame:
    sets = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.collect_set(F.col("l_suppkey") % 40).alias("g"), F.collect_set("l_linenumber").alias("s"))
    lines = t.part.select("p_partkey", F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("title")).join(sets, "p_partkey")
    return clusters.same_title_pairs(lines, "p_partkey", "title", {"tags": "g", "sources": "s"})


@query("q_centrality", "G9", """
    WITH m AS (SELECT o_custkey, count(*) AS m FROM orders GROUP BY 1) SELECT o_custkey, l_partkey % 50 AS source, count(DISTINCT o_orderkey) AS documents, floor(count(DISTINCT o_orderkey) / max(m) * 100.0e0 + 0.5e0) / 100.0e0 AS centrality
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN m USING (o_custkey) GROUP BY 1, 2""")
def centrality(t: Tables) -> DataFrame:
    citations = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_partkey") % 50).alias("source"))
    return clusters.source_centrality(t.orders, "o_custkey", "o_orderkey", citations, "source", t.parts("lineitem"))


@query("q_profiles", "F23", """
    WITH r AS (SELECT p_brand, p_name, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part)
    SELECT p_brand, 'brand ' || p_brand || ' ' || string_agg(p_name || ' ' || p_type, ' ' ORDER BY r) AS profile FROM r WHERE r <= 9 GROUP BY 1""")
def profiles(t: Tables) -> DataFrame:
    rows = t.part.withColumn("label", F.lit("brand ")).withColumn("tags", F.array("p_brand"))
    return clusters.profile_texts(rows, "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")], ["p_name", "p_type"], "label", ["tags"])


@query("q_vector_records", "K9", """
    SELECT o_orderkey, 'Título: order ' || o_orderkey || chr(10) || 'Resumen: ' || o_orderpriority || chr(10) || 'Análisis: ' AS text, CASE WHEN o_orderstatus = 'O' THEN 1000 + o_custkey ELSE CAST(epoch(o_orderdate) AS BIGINT) END AS u_time, o_orderstatus = 'F' AS applied, false AS renewed FROM orders""")
def vector_records(t: Tables) -> DataFrame:
    docs = t.orders.withColumn("applied", F.col("o_orderstatus") == "F").withColumn("renewed", F.lit(None).cast("int"))
    seconds = F.when(F.col("o_orderstatus") == "O", F.col("o_custkey") + 1000).when(F.col("o_orderstatus") == "F", 0)
    return clusters.vector_records(docs, "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), F.col("o_orderpriority"), F.lit(None).cast("string"), F.col("o_orderdate"), seconds, ["applied", "renewed"])
