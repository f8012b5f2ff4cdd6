"""Queries on changing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import numbers
from corpusmill.operators import changes
from corpusmill.plans.registry import Tables, query

AS_OF = "1998-08-02 00:00:00"


def _old_new(t: Tables) -> tuple[DataFrame, DataFrame]:
    old = t.customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("state"))
    new = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 == 0, F.upper("c_name")).alias("name"), F.lit("NEW").alias("state"))
    return old, new


_OLD = "o AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS state FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN upper(c_name) END AS name, 'NEW' AS state FROM customer WHERE c_custkey % 2 = 0)"


@query("q_upsert", "K1 K2", f"""
    WITH {_OLD} SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NOT NULL AND o.state <> 'BUILDING' THEN o.name ELSE coalesce(n.name, o.name) END AS name,
        CASE WHEN o.id IS NOT NULL AND o.state <> 'BUILDING' THEN o.state ELSE coalesce(n.state, o.state) END AS state FROM o FULL JOIN n ON o.id = n.id""")
def upsert(t: Tables) -> DataFrame:
    old, new = _old_new(t)
    return changes.upsert(old, new, "id", skip=F.col("state") != "BUILDING")


@query("q_ignore", "K3", f"WITH {_OLD} SELECT * FROM o UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM o)")
def ignore(t: Tables) -> DataFrame:
    old, new = _old_new(t)
    return changes.insert_or_ignore(old, new, ["id"], [F.col("name")])


@query("q_replace", "K4", f"WITH {_OLD} SELECT * FROM o WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT id, NULL, state FROM n")
def replace(t: Tables) -> DataFrame:
    old, new = _old_new(t)
    return changes.insert_or_replace(old, new.drop("name"), ["id"], [F.col("state")]).select("id", "name", "state")


@query("q_merge_spec", "K5", """
    WITH o AS (SELECT o_custkey AS id, count(*) AS n, max(o_orderdate) AS last, min(o_orderpriority) AS p, min(o_orderstatus) AS s FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
    n AS (SELECT o_custkey AS id, count(*) AS n, max(o_orderdate) AS last, min(o_orderpriority) AS p, nullif(min(o_orderstatus), 'F') AS s FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
    SELECT coalesce(o.id, n.id) AS id, coalesce(o.n, 0) + coalesce(n.n, 0) AS n, greatest(o.last, n.last) AS last, CASE WHEN o.id IS NULL THEN n.p ELSE coalesce(o.p, n.p) END AS p, CASE WHEN n.id IS NULL THEN o.s ELSE coalesce(n.s, o.s) END AS s FROM o FULL JOIN n ON o.id = n.id""")
def merge_spec(t: Tables) -> DataFrame:
    part = lambda m: t.orders.where(F.col("o_orderkey") % 2 == m).groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last"), F.min("o_orderpriority").alias("p"), F.min("o_orderstatus").alias("s"))
    new = part(1).withColumn("s", F.nullif("s", F.lit("F")))
    return changes.merge(part(0), new, "id", {"n": "add", "last": "greatest", "p": "keep", "s": "coalesce"})


@query("q_replace_children", "K6", """
    SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT l_orderkey, l_linenumber, -l_quantity FROM lineitem WHERE l_returnflag = 'R'""")
def replace_children(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    new = rows.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", (-F.col("l_quantity")).alias("l_quantity"))
    return changes.replace_children(rows.drop("l_returnflag"), new, "l_orderkey")


@query("q_dim_ids", "K8", """
    WITH d AS (SELECT p_type AS code, min(p_partkey) AS id FROM part WHERE p_partkey <= 3 GROUP BY 1), f AS (SELECT DISTINCT p_type AS code FROM part WHERE p_type NOT IN (SELECT code FROM d))
    SELECT code, id FROM d UNION ALL SELECT code, (SELECT coalesce(max(id), 0) FROM d) + row_number() OVER (ORDER BY code) FROM f""")
def dim_ids(t: Tables) -> DataFrame:
    dimension = t.part.where("p_partkey <= 3").groupBy(F.col("p_type").alias("code")).agg(F.min("p_partkey").alias("id"))
    return changes.dimension_ids(dimension, t.part.select(F.col("p_type").alias("code")), "code", "id")


@query("q_cdc", "K12", f"""
    WITH {_OLD}, j AS (SELECT o.id, o.name AS a, n.name AS b, o.state AS c, n.state AS d FROM o JOIN n ON o.id = n.id)
    SELECT id, 'name' AS field, a AS before, b AS after FROM j WHERE a IS DISTINCT FROM b UNION ALL SELECT id, 'state', c, d FROM j WHERE c IS DISTINCT FROM d""")
def cdc(t: Tables) -> DataFrame:
    old, new = _old_new(t)
    return changes.change_log(old, new, "id", ["name", "state"])


@query("q_event_log", "K13", f"""
    SELECT o_orderkey, 'imported' AS event_type, '{{"o_orderstatus":"' || o_orderstatus || '","o_custkey":' || o_custkey || '}}' AS metadata, TIMESTAMP '{AS_OF}' AS created_at FROM orders""")
def event_log(t: Tables) -> DataFrame:
    return changes.events_of(t.orders, "o_orderkey", "imported", ["o_orderstatus", "o_custkey"], F.lit(AS_OF).cast("timestamp"))


@query("q_json_patch", "K14", """SELECT event_id, '{"k":"' || (props->>'k') || '","seen":"true"}' AS props FROM events""")
def json_patch(t: Tables) -> DataFrame:
    return t.events.select("event_id", numbers.patched(F.col("props"), "seen", F.lit(True)).alias("props"))


@query("q_snapshot", "K7", """
    WITH s AS (SELECT o_orderpriority AS label, count(*) AS n, CAST(max(o_orderdate) AS DATE) AS d FROM orders GROUP BY 1) SELECT label, n, '1998-08-02' AS snapshot_date FROM s ORDER BY n DESC, label LIMIT 3""")
def snapshot(t: Tables) -> DataFrame:
    counts = t.orders.groupBy(F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("n"))
    order = [F.desc("n"), F.col("label")]
    return changes.latest_snapshot(changes.union_all([changes.snapshot(counts, d, order, 3) for d in ("1998-08-01", "1998-08-02")]))


@query("q_checkout", "C25 C26 O1", """
    WITH c AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P') AND year(o_orderdate) >= 1994 ORDER BY o_totalprice DESC, o_orderkey LIMIT 40)
    SELECT o_orderkey, 'checked_out' AS event_type, o_orderstatus AS status_from, 'W' AS status_to FROM c""")
def checkout(t: Tables) -> DataFrame:
    eligible = F.col("o_orderstatus").isin("O", "P") & (F.year("o_orderdate") >= 1994)
    _, events = changes.check_out(t.orders, eligible, [F.desc("o_totalprice"), F.col("o_orderkey")], 40, "o_orderstatus", "W", "o_orderkey", F.lit(AS_OF).cast("timestamp"))
    return events.drop("created_at")


@query("q_reclassify", "C27", """
    WITH r AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_totalprice > 400000 THEN 'large' WHEN o_orderstatus = 'P' THEN 'partial' WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' THEN 'urgent' END AS rule FROM orders)
    SELECT o_orderkey, rule, o_orderstatus AS status_from, CASE rule WHEN 'large' THEN 'F' WHEN 'partial' THEN 'O' ELSE 'P' END AS status_to FROM r WHERE rule IS NOT NULL AND o_orderstatus <> CASE rule WHEN 'large' THEN 'F' WHEN 'partial' THEN 'O' ELSE 'P' END""")
def reclassify(t: Tables) -> DataFrame:
    rules = [("large", F.col("o_totalprice") > 400000, "F"), ("partial", F.col("o_orderstatus") == "P", "O"), ("urgent", (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O"), "P")]
    return changes.reclassify(t.orders, "o_orderstatus", "o_orderkey", rules)[1]


@query("q_stuck", "P15", f"SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '{AS_OF}' - INTERVAL 2 HOUR")
def stuck(t: Tables) -> DataFrame:
    return changes.stuck(t.orders, "o_orderdate", F.lit(AS_OF).cast("timestamp"), 2, F.col("o_orderstatus") == "P").select("o_orderkey")
