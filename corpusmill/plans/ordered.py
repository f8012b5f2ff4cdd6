"""Queries on windows and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import joins, windows
from corpusmill.plans.registry import Tables, query


@query("q_top20_per_key", "W2 G5", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 20")
def top20(t: Tables) -> DataFrame:
    return joins.best_per_key(t.lineitem, ["l_suppkey"], [F.desc("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")], 20).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("q_span", "W3 F36", """
    SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS oldest, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest, min(o_orderdate) AS from_ts, max(o_orderdate) AS to_ts,
        floor(date_diff('day', min(o_orderdate), max(o_orderdate)) / 365.25 * 100.0 + 0.5) / 100.0 AS years FROM orders GROUP BY 1""")
def span(t: Tables) -> DataFrame:
    return windows.span(t.orders, ["o_custkey"], "o_orderkey", "o_orderdate")


@query("q_minmax", "W4", """
    WITH x AS (SELECT o_orderkey, o_custkey, epoch(o_orderdate)::BIGINT AS v FROM orders), y AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi, row_number() OVER (PARTITION BY o_custkey ORDER BY v) AS r, count(*) OVER w AS n FROM x WINDOW w AS (PARTITION BY o_custkey)),
    z AS (SELECT *, max(CASE WHEN r = floor(n / 2) + 1 THEN v END) OVER (PARTITION BY o_custkey) AS mid FROM y)
    SELECT o_orderkey, o_custkey, v, CASE WHEN hi > lo THEN floor((v - lo) / (hi - lo) * 1000.0 + 0.5) / 1000.0 ELSE 0.5 END AS scaled, CASE WHEN hi > lo THEN floor((1 - abs(v - mid) / (hi - lo)) * 1000.0 + 0.5) / 1000.0 ELSE 1.0 END AS centrality FROM z""")
def minmax(t: Tables) -> DataFrame:
    return windows.scaled(t.orders.select("o_orderkey", "o_custkey", F.unix_timestamp("o_orderdate").alias("v")), ["o_custkey"], "v")


@query("q_norm_rank", "W5", """
    SELECT o_orderkey, o_custkey, o_totalprice, floor(o_totalprice / max(o_totalprice) OVER (PARTITION BY o_custkey) * 10000.0 + 0.5) / 10000.0 AS normalised, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS INT) AS rank_index FROM orders""")
def norm_rank(t: Tables) -> DataFrame:
    return windows.normalised(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "o_orderkey")


@query("q_materia_scores", "W6 V10", """
    WITH r AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS i FROM orders)
    SELECT o_custkey, o_orderpriority, floor(CAST(sum(CAST(CASE WHEN i = 0 THEN 1.6 ELSE greatest(0.45, 1.15 - i * 0.08) END AS DECIMAL(18,4))) AS DOUBLE) * 100.0 + 0.5) / 100.0 AS score, count(*) AS hits FROM r GROUP BY 1, 2""")
def materia_scores(t: Tables) -> DataFrame:
    return windows.decayed_rank_scores(t.orders, "o_custkey", "o_orderpriority", "o_totalprice", "o_orderkey")


@query("q_family", "W7", """
    SELECT p_partkey, p_brand, p_retailprice, floor((max(p_retailprice) OVER (PARTITION BY p_brand) - p_retailprice) * 100.0 + 0.5) / 100.0 AS gap, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1 AS leads FROM part""")
def family(t: Tables) -> DataFrame:
    return windows.family_relative(t.part.select("p_partkey", "p_brand", "p_retailprice"), "p_brand", "p_retailprice", "p_partkey")


@query("q_active_slice", "W8", """
    SELECT o_orderkey, o_custkey FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS last FROM orders) WHERE o_orderdate >= CAST(last AS DATE) - INTERVAL 48 MONTH OR o_orderpriority = '1-URGENT'""")
def active_slice(t: Tables) -> DataFrame:
    return windows.active_slice(t.orders, ["o_custkey"], "o_orderdate", 4, F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "o_custkey")


@query("q_last_n", "W11 S13", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def last_n(t: Tables) -> DataFrame:
    return joins.best_per_key(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], [F.desc("turn")], 3)


@query("q_transitions", "W12", """
    SELECT event_id, user_id, event_type, lag(event_type) OVER w AS state_before, lag(event_type) OVER w IS DISTINCT FROM event_type AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def transitions(t: Tables) -> DataFrame:
    return windows.transitions(t.events, "user_id", "ts", "event_id", "event_type").select("event_id", "user_id", "event_type", "state_before", "changed")


@query("q_bigrams", "W9", """
    WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM benchmark), b AS (SELECT item_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM w)
    SELECT bigram, count(*) AS n FROM b GROUP BY 1""")
def bigrams(t: Tables) -> DataFrame:
    return t.benchmark.select(F.explode(windows.bigrams(F.col("text"))).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n"))


@query("q_flag_order", "O2 O3", "SELECT o_orderkey, o_orderstatus, CAST((o_orderstatus = 'F')::INT + (o_orderpriority = '1-URGENT')::INT + (o_totalprice > 200000)::INT AS INT) AS score FROM orders ORDER BY (o_orderstatus = 'F') DESC, score DESC, o_orderdate DESC, o_orderkey LIMIT 50")
def flag_order(t: Tables) -> DataFrame:
    score = (F.col("o_orderstatus") == "F").cast("int") + (F.col("o_orderpriority") == "1-URGENT").cast("int") + (F.col("o_totalprice") > 200000).cast("int")
    return t.orders.withColumn("score", score).orderBy((F.col("o_orderstatus") == "F").desc(), F.desc("score"), F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_orderstatus", "score")
