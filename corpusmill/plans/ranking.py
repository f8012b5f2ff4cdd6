"""Queries on sources, stored forms and the order in which results are shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import keys
from corpusmill.operators import joins, scoring
from corpusmill.plans.registry import Tables, query
from corpusmill.sources import tables


@query("q_sources", "S5 S12", """
    SELECT event_id, CAST(props->>'k' AS INT) AS k FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 7 DAY AND ts < TIMESTAMP '2024-01-15 00:00:00'""")
def sources(t: Tables) -> DataFrame:
    rows = tables.in_range(t.events, "ts", None, None, as_of="2024-01-15 00:00:00", days=7)
    wrapped = F.concat(F.lit('{"source": '), F.col("props"), F.lit("}"))
    return rows.select("event_id", F.get_json_object(tables.unwrapped(wrapped), "$.k").cast("int").alias("k"))


@query("q_star", "J2 J3", """
    SELECT p_brand, c_mktsegment, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""")
def star(t: Tables) -> DataFrame:
    # the facts join on their key; both catalogs are small beside them and Spark broadcasts what it measures as such
    facts = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
    return facts.join(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey").join(t.part.select("p_partkey", "p_brand"), "p_partkey").groupBy("p_brand", "c_mktsegment").agg(F.count("*").alias("n"))


@query("q_legal_norm", "F50", """
    SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Ley' WHEN 1 THEN 'Decreto' ELSE 'Código del Trabajo' END AS kind, CASE WHEN p_size % 3 = 2 THEN p_partkey || '.000' ELSE p_partkey || '000' END AS number, CAST(p_size AS VARCHAR) AS article FROM part""")
def legal_norm(t: Tables) -> DataFrame:
    m = F.col("p_size") % 3
    kind = F.when(m == 0, " LEY ").when(m == 1, "dto").otherwise("ctb")
    form = keys.stored_source(kind, F.concat(F.col("p_partkey").cast("string"), F.lit(".000")), F.concat(F.lit("Artículo "), F.col("p_size").cast("string")), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return t.part.select("p_partkey", form.alias("s")).select("p_partkey", "s.kind", "s.number", "s.article")


@query("q_canon_key", "F52", """
    SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Ley|' || p_partkey || '|' || p_size WHEN 1 THEN 'Decreto|' || p_partkey || '|2004|minis|' || p_size WHEN 2 THEN 'Código|Código Civil|' || p_size END AS key FROM part""")
def canon_key(t: Tables) -> DataFrame:
    m = F.col("p_size") % 4
    kind = F.when(m == 0, "Ley").when(m == 1, "Decreto").when(m == 2, "Código Civil").otherwise("CPR")
    return t.part.select("p_partkey", keys.regime_key(kind, F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.lit("2004"), F.lit("Ministerio")).alias("key"))


@query("q_cards", "F56 F23", """
    SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS mentions, list(DISTINCT p_type ORDER BY p_type) AS articles, arg_max(p_name, (p_retailprice, p_name)) AS label FROM part GROUP BY 1""")
def cards(t: Tables) -> DataFrame:
    return keys.source_cards(t.part, "p_brand", "p_name", "p_type", "p_size", "p_retailprice")


@query("q_alignment", "", """
    SELECT o_orderkey, floor(least(1.2e0, (o_totalprice / 500000.0e0 * 0.42e0 + 0.5e0 * 0.34e0 + CASE WHEN o_orderpriority = '1-URGENT' THEN 0.4e0 ELSE 0.0e0 END) * CASE WHEN o_orderstatus = 'P' THEN 0.58e0 ELSE 1.0e0 END * CASE WHEN year(o_orderdate) < 1994 THEN 0.72e0 ELSE 1.0e0 END) * 1000.0e0 + 0.5e0) / 1000.0e0 AS alignment FROM orders""")
def alignment(t: Tables) -> DataFrame:
    value = scoring.query_alignment(F.col("o_totalprice") / 500000.0, F.lit(0.5), F.when(F.col("o_orderpriority") == "1-URGENT", 0.4).otherwise(0.0), F.col("o_orderstatus") == "P", F.year("o_orderdate") < 1994)
    return t.orders.select("o_orderkey", value.alias("alignment"))


@query("q_direct_hits", "", """
    WITH n AS (SELECT o_custkey, o_orderkey, o_totalprice / max(o_totalprice) OVER (PARTITION BY o_custkey) AS n, (o_orderkey % 5) / 5.0e0 AS c FROM orders), v AS (SELECT *, floor((n * 1.45e0 + c * 2.2e0) * 10000.0e0 + 0.5e0) / 10000.0e0 AS value FROM n),
    g AS (SELECT *, row_number() OVER w AS place, n - lead(n) OVER w AS gap FROM v WINDOW w AS (PARTITION BY o_custkey ORDER BY value DESC, o_orderkey))
    SELECT o_custkey, o_orderkey, value, CAST(place AS INT) AS place, place = 1 AND n >= 0.9 AND coalesce(gap, 1.0e0) >= 0.04e0 AS strong FROM g""")
def direct_hits(t: Tables) -> DataFrame:
    hits = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", ((F.col("o_orderkey") % 5) / 5.0).alias("c"))
    return scoring.direct_hits(hits, "o_custkey", "o_orderkey", "o_totalprice", "c").select("o_custkey", "o_orderkey", "value", "place", "strong")


@query("q_pivots", "C13 C16", """
    WITH r AS (SELECT l_suppkey, l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS m, count(*) FILTER (WHERE l_returnflag = 'A') AS s, max(l_shipdate) AS ts FROM lineitem GROUP BY 1, 2)
    SELECT l_suppkey, CASE WHEN m > s THEN newest ELSE l_orderkey END AS representative FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY m DESC, s DESC, ts DESC, l_orderkey) AS r, first_value(l_orderkey) OVER (PARTITION BY l_suppkey ORDER BY ts DESC, l_orderkey) AS newest FROM r) WHERE r = 1""")
def pivots(t: Tables) -> DataFrame:
    f = F.col("l_returnflag")
    rows = t.lineitem.groupBy("l_suppkey", "l_orderkey").agg(F.count_if(f == "R").alias("m"), F.count_if(f == "A").alias("s"), F.max("l_shipdate").alias("ts"))
    newest = joins.best_per_key(rows, ["l_suppkey"], [F.desc("ts"), F.col("l_orderkey")]).select("l_suppkey", F.col("l_orderkey").alias("newest"))
    chosen = scoring.pivots(rows, "l_suppkey", "l_orderkey", "m", "s", "ts").join(newest, "l_suppkey").withColumn("gone", F.col("m") > F.col("s"))
    return scoring.visible_representatives(chosen, "l_orderkey", "newest", "gone").select("l_suppkey", "representative")


@query("q_presented", "", """
    WITH b AS (SELECT p_partkey, p_brand, p_retailprice / 2000.0e0 * 0.7e0 + p_size / 50.0e0 * 0.3e0 AS b, p_type = 'ECONOMY' AS anchor FROM part), l AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY b DESC, p_partkey) = 1 AS lead FROM b)
    SELECT p_partkey, floor(CASE WHEN lead THEN b ELSE b * 2 / 3 END * 10000.0e0 + 0.5e0) / 10000.0e0 AS shown_score FROM l""")
def presented(t: Tables) -> DataFrame:
    lines = t.part.select("p_partkey", "p_brand", (F.col("p_retailprice") / 2000.0).alias("s"), (F.col("p_size") / 50.0).alias("m"), (F.col("p_type") == "ECONOMY").alias("anchor"))
    return scoring.presented(lines, "p_brand", "p_partkey", "s", "m", "anchor").select("p_partkey", "shown_score")
