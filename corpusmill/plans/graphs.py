"""Queries on the relation graph. Documents are orders, edges lead to an order's suppliers; actions come from return flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators import graph, proposals
from corpusmill.plans.registry import Tables, query
from corpusmill.sources.tables import checkpointed

_ACTION = "CASE l_returnflag WHEN 'R' THEN 'reconsidered' WHEN 'A' THEN 'applies' ELSE 'complemented' END"
_EFFECT = "CASE l_returnflag WHEN 'R' THEN 'displaces' WHEN 'A' THEN 'strengthens' ELSE 'develops' END"


def _edges(t: Tables) -> DataFrame:
    a = F.when(F.col("l_returnflag") == "R", "reconsidered").when(F.col("l_returnflag") == "A", "applies").otherwise("complemented")
    return t.lineitem.select(F.col("l_orderkey").alias("src"), (-F.col("l_suppkey") - 1).alias("dst"), a.alias("action"), "l_shipdate", "l_linenumber")


_E = f"e AS (SELECT l_orderkey AS src, -l_suppkey - 1 AS dst, {_ACTION} AS action, {_EFFECT} AS effect, l_shipdate, l_linenumber FROM lineitem)"


@query("q_effects", "G1 A15 A23", f"""
    WITH {_E}, b AS (SELECT src AS node, 'out_' || effect AS kind FROM e UNION ALL SELECT dst, 'in_' || effect FROM e)
    SELECT node, {", ".join(f"count(*) FILTER (WHERE kind = '{d}_{x}') AS {d}_{x}" for d in ("in", "out") for x in graph.EFFECTS)} FROM b GROUP BY 1""")
def effects(t: Tables) -> DataFrame:
    return graph.effect_histograms(_edges(t).withColumn("effect", graph.effect(F.col("action"))))


@query("q_neighbours", "G2 J17 J19", f"""
    WITH {_E}, f AS (SELECT -s_suppkey - 1 AS id FROM supplier)
    SELECT dst AS focus, src AS id, action, 'in' AS direction, o_orderstatus AS status FROM e JOIN f ON e.dst = f.id JOIN orders ON o_orderkey = e.src""")
def neighbours(t: Tables) -> DataFrame:
    nodes = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    focus = t.supplier.select((-F.col("s_suppkey") - 1).alias("id"))
    return graph.neighbours(_edges(t).select("src", "dst", "action"), nodes, "id", focus).select("focus", "id", "action", "direction", "status")


@query("q_community", "G3", f"""
    WITH {_E}, s AS (SELECT o_orderkey AS k FROM orders)
    SELECT k AS seed, k AS member, 'seed' AS role FROM s UNION ALL SELECT DISTINCT src, dst, 'cited' FROM e JOIN s ON e.src = s.k""")
def community(t: Tables) -> DataFrame:
    return graph.communities(_edges(t), t.orders.select(F.col("o_orderkey").alias("k")), "k", t.parts("lineitem"))


@query("q_family_edges", "G5", f"""
    WITH {_E}, k AS (SELECT o_orderkey AS k FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT -s_suppkey - 1 FROM supplier WHERE s_nationkey < 12)
    SELECT src, dst, l_linenumber, src IN (SELECT k FROM k) AND dst IN (SELECT k FROM k) AS inside_family FROM e WHERE src IN (SELECT k FROM k) OR dst IN (SELECT k FROM k) ORDER BY src, dst, l_linenumber LIMIT 120""")
def family_edges(t: Tables) -> DataFrame:
    keys = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("k")).unionByName(t.supplier.where("s_nationkey < 12").select((-F.col("s_suppkey") - 1).alias("k")))
    return graph.inside_family(_edges(t).select("src", "dst", "l_linenumber"), keys, "k", 120, [F.col("src"), F.col("dst"), F.col("l_linenumber")])


@query("q_regime", "G6 G7", f"""
    WITH {_E}, s AS (SELECT dst, count(*) AS members, count(*) FILTER (WHERE effect = 'displaces') AS displacing, count(*) FILTER (WHERE effect IN ('limits', 'displaces')) AS limiting, count(*) FILTER (WHERE effect = 'strengthens') AS strengthening FROM e GROUP BY 1),
    x AS (SELECT *, floor(greatest(0.0, 1 - limiting / members * 2) * 1000.0 + 0.5) / 1000.0 AS stability FROM s)
    SELECT dst, members, displacing, limiting, strengthening, CASE WHEN displacing > strengthening THEN 'displaced' WHEN limiting / members > 0.3 THEN 'contested' WHEN limiting > 0 THEN 'in_transition' WHEN members >= 3 THEN 'stable' ELSE 'forming' END AS state,
        stability, floor(least(1.0, members / 27000) * 100000.0 + 0.5) / 100000.0 AS coverage, floor(least(1.0, stability * CAST(0.7 AS DOUBLE) + least(CAST(0.3 AS DOUBLE), members * CAST(0.05 AS DOUBLE)) + CAST(0.1 AS DOUBLE)) * 1000.0 + 0.5) / 1000.0 AS confidence FROM x""")
def regime(t: Tables) -> DataFrame:
    return graph.regime(_edges(t).withColumn("effect", graph.effect(F.col("action"))), "dst")


@query("q_timeline", "G8", f"""
    WITH {_E} SELECT dst, 'founded' AS event, arg_min(src, (l_shipdate, src)) AS src, min(l_shipdate) AS l_shipdate FROM e GROUP BY 1
    UNION ALL SELECT dst, 'consolidated', arg_max(src, (l_shipdate, src)), max(l_shipdate) FROM e WHERE effect = 'strengthens' GROUP BY 1
    UNION ALL SELECT dst, 'displaced', arg_max(src, (l_shipdate, src)), max(l_shipdate) FROM e WHERE effect = 'displaces' GROUP BY 1""")
def timeline(t: Tables) -> DataFrame:
    return graph.timeline(_edges(t).withColumn("effect", graph.effect(F.col("action"))), "dst", "src", "l_shipdate")


@query("q_route", "G4", f"""
    WITH {_E} SELECT dst, src, l_linenumber, CAST(row_number() OVER w AS INT) AS step, count(*) FILTER (WHERE effect IN ('limits', 'displaces')) OVER w AS against,
        CASE WHEN max(CASE WHEN effect = 'displaces' THEN 1 ELSE 0 END) OVER w = 1 THEN 'displaced' WHEN count(*) FILTER (WHERE effect IN ('limits', 'displaces')) OVER w > 0 THEN 'qualified' ELSE 'current' END AS status
    FROM e WINDOW w AS (PARTITION BY dst ORDER BY l_shipdate, src * 10 + l_linenumber)""")
def route(t: Tables) -> DataFrame:
    e = _edges(t).withColumn("effect", graph.effect(F.col("action"))).withColumn("k", F.col("src") * 10 + F.col("l_linenumber"))
    return graph.route(e, "dst", "l_shipdate", "k").select("dst", "src", "l_linenumber", "step", "against", "status")


@query("q_retro", "G12", f"WITH {_E} SELECT dst, list(DISTINCT CASE action WHEN 'applies' THEN 'applied' ELSE action END ORDER BY CASE action WHEN 'applies' THEN 'applied' ELSE action END) AS flags FROM e GROUP BY 1")
def retro(t: Tables) -> DataFrame:
    return graph.retro_flags(_edges(t))


@query("q_missing_rel", "", """
    WITH p AS (SELECT o_orderkey AS src, o_orderkey + 1 AS dst FROM orders), w AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS i FROM lineitem), s AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS i FROM lineitem),
    wn AS (SELECT k, count(*) AS n FROM w GROUP BY 1), sn AS (SELECT k, count(*) AS n FROM s GROUP BY 1),
    wj AS (SELECT src, dst, count(*) / (max(a.n) + max(b.n) - count(*)) AS j FROM p JOIN w x ON x.k = src JOIN w y ON y.k = dst AND y.i = x.i JOIN wn a ON a.k = src JOIN wn b ON b.k = dst GROUP BY 1, 2),
    sj AS (SELECT src, dst, count(*) / (max(a.n) + max(b.n) - count(*)) AS j FROM p JOIN s x ON x.k = src JOIN s y ON y.k = dst AND y.i = x.i JOIN sn a ON a.k = src JOIN sn b ON b.k = dst GROUP BY 1, 2),
    o AS (SELECT p.src, p.dst, coalesce(wj.j, 0.0) AS w, coalesce(sj.j, 0.0) AS s FROM p LEFT JOIN wj ON p.src = wj.src AND p.dst = wj.dst LEFT JOIN sj ON p.src = sj.src AND p.dst = sj.dst),
    c AS (SELECT src, dst, floor((w * CAST(0.6 AS DOUBLE) + s * CAST(0.4 AS DOUBLE)) * 1000.0 + 0.5) / 1000.0 AS confidence, CASE WHEN s >= 0.5 THEN 'applied' WHEN w >= 0.5 THEN 'complemented' ELSE 'clarified' END AS kind FROM o)
    SELECT * FROM c WHERE confidence >= 0.3""")
def missing_rel(t: Tables) -> DataFrame:
    pairs = t.orders.select(F.col("o_orderkey").alias("src"), (F.col("o_orderkey") + 1).alias("dst"))
    words = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("word"))
    sources = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("source"))
    return graph.missing_relations(pairs, words, sources, "k")


_DESCRIPTORS = "SELECT DISTINCT o_orderkey AS k, lower(p_type) AS item FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey"


@query("q_proposals", "G13", f"""
    WITH d AS ({_DESCRIPTORS}), w AS (SELECT DISTINCT k, item FROM (SELECT k, unnest(string_split(item, ' ')) AS item FROM d UNION ALL SELECT o_orderkey, unnest(string_split_regex(lower(o_orderpriority || ' ' || p_name), '[^a-z0-9]+')) FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey) WHERE length(item) >= 4),
    n AS (SELECT o_orderkey AS k, CAST(p_brand AS VARCHAR) AS item FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, item) <= 5),
    i AS (SELECT k, 'd' AS kind, item FROM d UNION ALL SELECT k, 'w', item FROM w UNION ALL SELECT k, 'n', item FROM n), c AS (SELECT k, count(*) FILTER (WHERE kind = 'd') AS d, count(*) FILTER (WHERE kind = 'w') AS w, count(*) FILTER (WHERE kind = 'n') AS n FROM i GROUP BY 1),
    o AS (SELECT o_custkey, o_orderkey AS k, o_orderdate AS ts, o_orderpriority LIKE '%URGENT' AS r, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, o_orderstatus = 'F' AS linked, c.* FROM orders JOIN c ON k = o_orderkey),
    p AS (SELECT y.o_custkey, y.k AS src, x.k AS dst, y.r, x.d AS xd, x.w AS xw, x.n AS xn, y.d AS yd, y.w AS yw, y.n AS yn FROM o x JOIN o y ON x.o_custkey = y.o_custkey AND (x.ts, x.k) < (y.ts, y.k) WHERE NOT (y.linked AND y.before = x.k)),
    s AS (SELECT p.*, count(*) FILTER (WHERE a.kind = 'd') AS d, count(*) FILTER (WHERE a.kind = 'w') AS w, count(*) FILTER (WHERE a.kind = 'n') AS n, list_sort(list(a.item) FILTER (WHERE a.kind = 'd'))[1:3] AS shared FROM p JOIN i a ON a.k = src JOIN i b ON b.k = dst AND a.kind = b.kind AND a.item = b.item GROUP BY ALL),
    f AS (SELECT s.*, d / (xd + yd - d) AS fd, w / (xw + yw - w) AS fw, n / (xn + yn - n) AS fn, greatest(yd - d, least(yw - w, 3)) + r::INT AS semantic_delta, yn - n AS new_norms, src IN (first, last) OR dst IN (first, last) AS same_family, c_nationkey % 2 = 0 AS review
        FROM s JOIN customer ON c_custkey = o_custkey JOIN (SELECT o_custkey, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1) USING (o_custkey)),
    g AS (SELECT *, fd * 0.45e0 + fw * 0.35e0 + fn * 0.25e0 + CASE WHEN same_family THEN 0.1e0 ELSE 0.0e0 END + CASE WHEN semantic_delta > 0 THEN 0.1e0 ELSE 0.0e0 END + CASE WHEN new_norms > 0 THEN 0.05e0 ELSE 0.0e0 END + CASE WHEN review THEN 0.08e0 ELSE 0.04e0 END AS score FROM f
        WHERE (fd >= 0.1 OR fw >= 0.12 OR fn >= 0.1) AND (semantic_delta > 0 OR new_norms > 0 OR same_family))
    SELECT o_custkey, src, dst, floor(fd * 10000.0e0 + 0.5e0) / 10000.0e0 AS descriptor_overlap, floor(fw * 10000.0e0 + 0.5e0) / 10000.0e0 AS word_overlap, floor(fn * 10000.0e0 + 0.5e0) / 10000.0e0 AS norm_overlap, semantic_delta, new_norms, same_family, floor(score * 100.0e0 + 0.5e0) / 100.0e0 AS confidence,
        CASE WHEN score >= 0.78e0 THEN 'high' WHEN score >= 0.6e0 THEN 'medium' ELSE 'low' END AS level, CASE WHEN r AND new_norms > 0 THEN 'partly_reconsidered' WHEN semantic_delta >= 2 AND new_norms > 0 THEN 'complemented' WHEN semantic_delta >= 1 THEN 'clarified' ELSE 'complemented' END AS kind, coalesce(shared, []) AS shared FROM g""")
def proposals_(t: Tables) -> DataFrame:
    """Customers are lines, their orders documents, types of parts descriptors and brands norms."""
    parts = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey")).join(t.part.select("p_partkey", "p_name", "p_type", "p_brand"), "p_partkey")
    orders = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    named = parts.groupBy("o_orderkey").agg(*[F.collect_list(c).alias(c) for c in ("p_name", "p_type", "p_brand")])
    texts = orders.select("o_orderkey", "o_orderpriority").join(named, "o_orderkey")
    # members and relations both read the items
    items = checkpointed(proposals.document_sets(texts, "o_orderkey", F.concat(F.array("o_orderpriority"), "p_name"), F.col("p_type"), F.col("p_brand")))
    ends = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("anchor"), F.max("o_orderkey").alias("representative"))
    lines = ends.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_nationkey") % 2 == 0, "in_review").otherwise("evolving").alias("status")), "o_custkey")
    members = orders.withColumn("restrictive", F.col("o_orderpriority").endswith("URGENT"))
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    edges = orders.join(items.select("o_orderkey"), "o_orderkey", "left_semi").withColumn("dst", before).where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("src"), "dst")
    return proposals.missing_relations(lines, "o_custkey", members, "o_orderkey", "o_orderdate", items, edges)


@query("q_mined", "", """
    SELECT o_orderkey AS src, unnest(['applied', 'confirmed']) AS action, unnest(['12' || o_custkey, '7']) AS number, unnest([strftime(o_orderdate, '%y'), '1999']) AS year FROM orders""")
def mined(t: Tables) -> DataFrame:
    docs = t.orders.select("o_orderkey", F.concat(F.lit("It applies the opinion 12."), F.col("o_custkey").cast("string"), F.lit("/"), F.date_format("o_orderdate", "yy"), F.lit(" and confirms 7/1999.")).alias("text"))
    return graph.mined_relations(docs, "o_orderkey", "text", {"applies": "applied", "confirms": "confirmed"})


@query("q_candidates", "G10", """
    WITH h AS (SELECT o_orderkey AS src, 'applied' AS action, CAST(o_custkey AS VARCHAR) AS number, CAST(year(o_orderdate) AS INT) AS year, 'table' AS channel FROM orders WHERE o_orderstatus <> 'P'),
    x AS (SELECT o_orderkey AS src, 'applied' AS action, CAST(o_custkey AS VARCHAR) AS number, CAST(year(o_orderdate) AS INT) AS year, 'text' AS channel FROM orders UNION ALL SELECT o_orderkey, 'confirmed', CAST(o_orderkey AS VARCHAR), 1997, 'text' FROM orders WHERE o_orderstatus <> 'F'),
    r AS (SELECT o_orderkey AS src, 'applied' AS action, '99' AS number, 2001 AS year, 'references' AS channel FROM orders WHERE o_orderstatus = 'F')
    SELECT * FROM h UNION ALL SELECT * FROM x WHERE (src, action, number, year) NOT IN (SELECT src, action, number, year FROM h) UNION ALL SELECT * FROM r""")
def candidates(t: Tables) -> DataFrame:
    number, year, status = F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyy"), F.col("o_orderstatus")
    table = F.concat(F.lit("<table><tr><th>Action</th><th>No</th><th>Year</th></tr><tr><td><b>Applies</b></td><td>N&nbsp;"), number, F.lit("</td><td>"), year, F.lit("</td></tr></table>"))
    said = F.concat(F.lit("applies opinion "), number, F.lit("/"), year, F.when(status == "F", "").otherwise(F.concat(F.lit("; confirms "), F.col("o_orderkey").cast("string"), F.lit("/97"))))
    refs = F.array(F.struct(F.lit("99N").alias("name"), F.lit("2001").alias("year")))
    docs = t.orders.select(F.col("o_orderkey").alias("src"), F.when(status != "P", table).alias("html"), said.alias("text"), refs.alias("refs"))
    return graph.candidate_relations(docs, "src", "html", "text", "refs", {"applies": "applied", "confirms": "confirmed"})


@query("q_orphans", "G11", """
    WITH refs AS (SELECT l_orderkey AS src, CAST(l_partkey AS VARCHAR) AS number, 1995 AS year FROM lineitem WHERE l_returnflag = 'R'), d AS (SELECT CAST(o_custkey AS VARCHAR) AS n, min(o_orderkey) AS id FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1)
    SELECT src, number, year, id AS dst, id IS NULL AS orphan, length(number) > 3 AS composed FROM refs LEFT JOIN d ON n = number""")
def orphans(t: Tables) -> DataFrame:
    refs = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").cast("string").alias("number"), F.lit(1995).alias("year"))
    docs = t.orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("n"), F.year("o_orderdate").alias("y"))
    edges, left = graph.resolved_edges(refs, docs, "o_orderkey", "n", "y", F.length("number") > 3)
    return edges.unionByName(left)
