"""Queries on feeds and guarded back-fills: tables are written in the form that an operator reads, and read back by it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import tag_norm
from corpusmill.operators import backfill
from corpusmill.plans.registry import Tables, query
from corpusmill.sources import feeds
from corpusmill.sources.pages import JsonPages
from corpusmill.sources.tables import new_folder


@query("q_feed", "S8", """
    SELECT 'D' || doc_id AS id, CASE WHEN doc_id % 4 = 1 THEN 'wrapped' ELSE 'own' END AS form, md5(text) AS text_md5, CASE WHEN doc_id % 4 < 2 THEN '} "{ \\ [' END AS note FROM documents WHERE doc_id % 4 <> 3""")
def feed(t: Tables) -> DataFrame:
    """Documents as pretty objects with trailing commas, in one line, inside a wrapper and without id, on lines of one file each task."""
    m, note = F.col("doc_id") % 4, F.lit('} "{ \\ [').alias("note")
    id_ = F.concat(F.lit("D"), F.col("doc_id").cast("string"))
    pretty = F.to_json(F.struct(id_.alias("id"), "text", note), {"pretty": "true"})
    wrapped = F.to_json(F.struct(F.struct(id_.alias("doc_id"), "text", note).alias("raw_data")))
    plain = F.when(m == 2, F.to_json(F.struct(id_.alias("id"), "text"))).otherwise(F.to_json(F.struct("text")))
    lines = t.documents.select(F.concat(F.lit("  "), F.when(m == 0, pretty).when(m == 1, wrapped).otherwise(plain), F.when(F.col("doc_id") % 5 < 4, ",").otherwise("")).alias("value"))
    folder = new_folder(t.spark, "feed")
    lines.write.text(folder)
    rows, _ = feeds.feed(feeds.json_objects(t.spark, folder))
    raw = F.col("raw_data")
    return rows.select("id", F.when(F.get_json_object(raw, "$.doc_id").isNull(), "own").otherwise("wrapped").alias("form"), F.md5(F.get_json_object(raw, "$.text")).alias("text_md5"), F.get_json_object(raw, "$.note").alias("note"))


@query("q_pages", "S4", """
    SELECT event_id // 1000 + 1 AS page, CAST(row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) - 1 AS INT) AS position, event_id, event_type, user_id FROM events""")
def pages(t: Tables) -> DataFrame:
    """Events as numbered pages of a thousand, an empty page after the last, and one behind it that doesn't count."""
    t.spark.dataSource.register(JsonPages)
    page = F.floor(F.col("event_id") / 1000) + 1
    hits = t.events.groupBy(page.alias("page")).agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type", "user_id"))).alias("hits"))
    last = hits.agg(F.max("page").alias("last"))
    none = F.filter(F.array(F.struct(F.lit(0).cast("long").alias("event_id"), F.lit("").alias("event_type"), F.lit(0).cast("long").alias("user_id"))), lambda x: x["event_id"] > 0)
    behind = last.select(F.explode(F.array((F.col("last") + 1), (F.col("last") + 2))).alias("page"), "last").select("page", F.when(F.col("page") == F.col("last") + 1, none).otherwise(F.array(F.struct(F.lit(-1).cast("long").alias("event_id"), F.lit("late").alias("event_type"), F.lit(0).cast("long").alias("user_id")))).alias("hits"))
    folder = new_folder(t.spark, "pages")
    rows = hits.unionByName(behind).select("page", F.to_json(F.struct(F.struct("hits").alias("hits"))).alias("value"))
    rows.repartition("page").write.partitionBy("page").text(folder)
    found = t.spark.read.format("json_pages").option("pattern", r"/page=(\d+)/[^/]*\.txt$").load(folder)
    return found.select("page", "position", F.from_json("item", "event_id long, event_type string, user_id long").alias("i")).select("page", "position", "i.*")


_MARKED = """
    x AS (SELECT event_id, user_id, event_id * 5 // (SELECT max(event_id) + 1 FROM events) AS w, event_type || CASE WHEN value >= 50 THEN ' high. ' ELSE ' LOW' END AS raw, event_id % 3 = 0 AND event_id * 5 // (SELECT max(event_id) + 1 FROM events) = 3 AS filler FROM events),
    v AS (SELECT *, lower(regexp_replace(trim(raw), '[.\\s]+$', '')) AS tag, CASE WHEN filler THEN 'filler' WHEN event_id % 97 = 5 THEN 'null_norm' WHEN user_id NOT IN (SELECT c_custkey FROM customer) THEN 'missing' ELSE 'accepted' END AS verdict FROM x),
    first AS (SELECT user_id, tag, min(w) AS w FROM v WHERE verdict = 'accepted' GROUP BY 1, 2)"""


def _backfilled(t: Tables) -> str:
    """Five windows over the events: the fourth has too many fillers, so the first run stops; the second one allows them."""
    path = new_folder(t.spark, "backfill")
    known = t.customer.select(F.col("c_custkey").alias("user_id"), F.lit(True).alias("_known"))
    n = t.events.agg(F.max("event_id")).first()[0] + 1
    raw = F.concat("event_type", F.when(F.col("value") >= 50, " high. ").otherwise(" LOW"))
    filler = (F.col("event_id") % 3 == 0) & (F.floor(F.col("event_id") * 5 / n) == 3)
    legacy = t.events.select("event_id", "user_id", F.when(filler, "unknown").when(F.col("event_id") % 97 == 5, "  ").otherwise(raw).alias("raw")).join(known, "user_id", "left")
    verdict = F.when(F.col("raw") == "unknown", "filler").when(tag_norm(F.col("raw")) == "", "null_norm").when(F.col("_known").isNull(), "missing").otherwise("accepted")
    relations = lambda rows: rows.select("user_id", tag_norm(F.col("raw")).alias("tag"))
    guards = lambda share: [backfill.count_over("missing"), backfill.share_over("null_norm", 0.02), backfill.share_over("filler", share)]
    for share in (0.25, 0.5):
        backfill.run_windows(legacy, "event_id", path, n // 5, verdict, relations, ["user_id", "tag"], guards(share), ["accepted", "filler", "null_norm", "missing"])
    return path


@query("q_backfill_ledger", "Q7", f"""
    WITH {_MARKED}, m AS (SELECT w, count(*) AS read, count(*) FILTER (WHERE verdict = 'accepted') AS accepted, count(*) FILTER (WHERE verdict = 'filler') AS filler, count(*) FILTER (WHERE verdict = 'null_norm') AS null_norm, min(event_id) AS start_key, max(event_id) AS end_key FROM v GROUP BY 1),
    n AS (SELECT w, count(*) AS new FROM first GROUP BY 1), tried AS (SELECT unnest([0, 1, 2, 3, 3, 4]) AS w, unnest([1, 2, 3, 4, 5, 6]) AS step)
    SELECT CAST(step AS BIGINT) AS step, start_key, end_key, read, accepted, filler, null_norm, coalesce(new, 0) AS new, CASE step WHEN 4 THEN 'blocked' ELSE 'applied' END AS status, CASE step WHEN 4 THEN 'filler_over_0.25' END AS reason FROM tried JOIN m USING (w) LEFT JOIN n USING (w)""")
def backfill_ledger(t: Tables) -> DataFrame:
    rows = backfill.ledger(t.spark, _backfilled(t))
    return rows.select("step", "start_key", "end_key", *[F.col("metrics")[m].alias(m) for m in ("read", "accepted", "filler", "null_norm", "new")], "status", "reason")


@query("q_backfill", "Q7", f"WITH {_MARKED} SELECT user_id, tag FROM first")
def backfilled(t: Tables) -> DataFrame:
    return backfill.published(t.spark, _backfilled(t), "user_id long, tag string")
