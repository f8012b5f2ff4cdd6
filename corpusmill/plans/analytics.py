"""Aggregate queries over the star schema and the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import aggregates as agg
from corpusmill.plans.registry import Tables, query
from corpusmill.sources.tables import dealt

AS_OF = "1998-08-02 00:00:00"
STAGES = {"O": "open", "F": "filled", "P": "partial"}


@query("q_heatmap", "A1 J2 O1", """
    WITH per_doc AS (
        SELECT CAST(year(o_orderdate) AS INT) AS year, l_orderkey, l_partkey, count(*) AS n, max(o_orderdate) AS d
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)
    SELECT year, p_type, p_brand, CAST(sum(n) AS BIGINT) AS mentions, count(*) AS documents, max(d) AS last_date
    FROM per_doc JOIN part ON p_partkey = l_partkey GROUP BY year, p_type, p_brand
    ORDER BY mentions DESC, documents DESC, year, p_type, p_brand LIMIT 500""")
def heatmap(t: Tables) -> DataFrame:
    parts = t.parts("lineitem")
    mentions = dealt(t.lineitem.select("l_orderkey", "l_partkey"), parts, "l_orderkey").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    labels = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand")
    return agg.mention_heatmap(mentions, "l_orderkey", "l_partkey", "o_orderdate", labels, ["p_type", "p_brand"], 500, parts)


@query("q_trends", "A2", """
    SELECT CAST(year(o_orderdate) AS INT) AS year, o_orderpriority AS label, count(*) AS total,
        count(*) FILTER (WHERE o_orderstatus = 'F') AS filled, max(o_orderdate) AS last_date
    FROM orders GROUP BY 1, 2""")
def trends(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("filled"), F.max("o_orderdate").alias("last_date"))


@query("q_stats", "A3", """
    SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total, max(max(o_orderdate)) OVER () AS last_updated
    FROM orders GROUP BY 1""")
def stats(t: Tables) -> DataFrame:
    by_year = t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last"))
    # a row a year: totals come from the small table
    total = by_year.agg(F.sum("n").alias("total"), F.max("last").alias("last_updated"))
    return by_year.crossJoin(F.broadcast(total)).select("year", "n", "total", "last_updated")


@query("q_volumetry", "A4", """
    SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS total,
        count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'F') AS filled, count(*) FILTER (WHERE o_orderstatus = 'P') AS partial,
        count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS low,
        count(*) FILTER (WHERE o_totalprice >= 200000) AS large, count(*) FILTER (WHERE o_totalprice < 50000) AS small
    FROM orders GROUP BY 1""")
def volumetry(t: Tables) -> DataFrame:
    df = t.orders.withColumn("year", F.year("o_orderdate"))
    s, p, v = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_totalprice")
    return agg.conditional_counts(df, ["year"], {"open": s == "O", "filled": s == "F", "partial": s == "P", "urgent": p == "1-URGENT", "low": p == "5-LOW", "large": v >= 200000, "small": v < 50000})


@query("q_status_stage", "A5 P11 J22", """
    WITH c(o_orderstatus, ordinal) AS (VALUES ('O', 1), ('F', 2))
    SELECT o.o_orderstatus AS status, CASE o.o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' WHEN 'P' THEN 'partial' ELSE 'other' END AS stage,
        CAST(coalesce(max(c.ordinal), 999) AS INT) AS ordinal, count(*) AS n
    FROM orders o LEFT JOIN c USING (o_orderstatus) GROUP BY 1, 2""")
def status_stage(t: Tables) -> DataFrame:
    catalog = t.spark.createDataFrame([("O", 1), ("F", 2)], "status string, ordinal int")
    stage = F.coalesce(*[F.when(F.col("status") == k, v) for k, v in STAGES.items()], F.lit("other"))
    counts = t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return counts.withColumn("stage", stage).join(catalog, "status", "left").select("status", "stage", F.coalesce("ordinal", F.lit(999)).alias("ordinal"), "n")


@query("q_crosstab", "A6", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def crosstab(t: Tables) -> DataFrame:
    return t.labels.groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("q_model_dist", "A7 P2 P12", """
    SELECT CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN 'Brand#1x' ELSE coalesce(nullif(trim(p_brand), ''), 'none') END AS model, count(*) AS n
    FROM part GROUP BY 1""")
def model_dist(t: Tables) -> DataFrame:
    folded = F.when(F.col("p_brand").isin("Brand#11", "Brand#12"), "Brand#1x").otherwise(F.coalesce(F.nullif(F.trim("p_brand"), F.lit("")), F.lit("none")))
    return t.part.groupBy(folded.alias("model")).agg(F.count("*").alias("n"))


@query("q_top_labels", "A8 A22", "SELECT p_type AS label, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, p_type) AS INT) AS rank FROM part GROUP BY 1 ORDER BY n DESC, label LIMIT 15")
def top_labels(t: Tables) -> DataFrame:
    return agg.most_frequent(t.part.select(F.col("p_type").alias("label")), [], "label", 15)


@query("q_impact", "A9 A31", """
    SELECT count(*) AS line_count, count(DISTINCT l_orderkey) AS documents, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS quantity,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS value
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'""")
def impact(t: Tables) -> DataFrame:
    filled = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice").join(filled, "l_orderkey")
    # lines are summed by document first: no distinct over all rows
    per_doc = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,4)")).alias("q"), F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).alias("v"))
    return per_doc.agg(F.sum("n").alias("line_count"), F.count("*").alias("documents"), F.sum("q").cast("double").alias("quantity"), F.sum("v").cast("double").alias("value"))


@query("q_quality_counts", "A10 A24 J1", """
    SELECT source, count(*) AS total, count(*) FILTER (WHERE quality IS NULL) AS unlabelled, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS clean,
        count(*) FILTER (WHERE quality = 0) AS poor, count(*) FILTER (WHERE toxic = 1) AS toxic, count(*) FILTER (WHERE length(text) < 200) AS short
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def quality_counts(t: Tables) -> DataFrame:
    # the text gives way to its length before rows are moved
    docs = t.documents.select("doc_id", "source", F.length("text").alias("n")).join(t.labels, "doc_id", "left")
    return agg.conditional_counts(docs, ["source"], {"unlabelled": F.col("quality").isNull(), "clean": (F.col("quality") == 1) & (F.col("toxic") == 0), "poor": F.col("quality") == 0, "toxic": F.col("toxic") == 1, "short": F.col("n") < 200})


@query("q_dashboard", "A11", """
    SELECT CASE WHEN event_type IN ('view', 'click') THEN 'browse' WHEN event_type = 'signup' THEN 'join' WHEN event_type = 'purchase' THEN 'buy' WHEN event_type = 'error' THEN 'fail' ELSE 'other' END AS bucket, count(*) AS n
    FROM events GROUP BY 1""")
def dashboard(t: Tables) -> DataFrame:
    e = F.col("event_type")
    bucket = F.when(e.isin("view", "click"), "browse").when(e == "signup", "join").when(e == "purchase", "buy").when(e == "error", "fail").otherwise("other")
    return t.events.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("q_migration", "A12", """
    SELECT count(*) AS total, count(*) FILTER (WHERE k = 0) AS first, count(*) FILTER (WHERE k = 1) AS second, count(*) FILTER (WHERE k = 2) AS third, count(*) FILTER (WHERE k = 3) AS rest
    FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN 0 WHEN o_totalprice > 300000 THEN 1 WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 3 END AS k FROM orders)""")
def migration(t: Tables) -> DataFrame:
    k = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_totalprice") > 300000, 1).when(F.col("o_orderpriority") == "1-URGENT", 2).otherwise(3)
    df = t.orders.select(k.alias("k"))
    return agg.conditional_counts(df, [], {name: F.col("k") == i for i, name in enumerate(("first", "second", "third", "rest"))})


@query("q_evolution", "A13 F32 F34", f"""
    SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS model, count(*) AS n FROM orders
    WHERE o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND o_orderdate <= TIMESTAMP '{AS_OF}' GROUP BY 1, 2""")
def evolution(t: Tables) -> DataFrame:
    as_of = F.lit(AS_OF).cast("timestamp")
    recent = t.orders.where((F.col("o_orderdate") >= as_of - F.expr("INTERVAL 30 DAYS")) & (F.col("o_orderdate") <= as_of))
    return recent.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderpriority").alias("model")).agg(F.count("*").alias("n"))


@query("q_mode_label", "A14 A16", """
    SELECT o_custkey, o_orderpriority, n, CAST(1 AS INT) AS rank FROM (
        SELECT o_custkey, o_orderpriority, count(*) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY 1, 2) WHERE r = 1""")
def mode_label(t: Tables) -> DataFrame:
    return agg.most_frequent(t.orders, ["o_custkey"], "o_orderpriority")


@query("q_dominant_source", "A16 A17", """
    SELECT o_custkey, p_type, n, CAST(r AS INT) AS rank FROM (
        SELECT o_custkey, p_type, count(*) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, p_type) AS r
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) WHERE r <= 3""")
def dominant_source(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_partkey").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return agg.most_frequent(lines.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey"), ["o_custkey"], "p_type", 3)


@query("q_distinct_fanout", "A18", """
    SELECT c_custkey, (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_custkey = c_custkey) AS priorities,
        (SELECT count(DISTINCT l_suppkey) FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey = c_custkey) AS suppliers
    FROM customer""")
def distinct_fanout(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").join(orders.select("o_orderkey", "c_custkey"), "o_orderkey")
    return agg.fan_out_counts(t.customer.select("c_custkey"), "c_custkey", {"priorities": orders.select("c_custkey", "o_orderpriority"), "suppliers": lines.select("c_custkey", "l_suppkey")})


@query("q_shared_norms", "A19 A20", """
    SELECT p_brand, count(DISTINCT l_orderkey) AS documents, (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT CAST(p2.p_size AS VARCHAR) AS s FROM part p2 JOIN lineitem l2 ON l2.l_partkey = p2.p_partkey WHERE p2.p_brand = part.p_brand)) AS spellings
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand HAVING count(DISTINCT l_orderkey) >= 2""")
def shared_norms(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(t.part.select("p_partkey", "p_brand", "p_size"), "p_partkey")
    return agg.shared_sources(lines, "l_orderkey", "p_size", "p_brand")


@query("q_json_tags", "A21 J8", """
    SELECT n_regionkey AS region, '[' || string_agg('"' || n_name || '"', ',' ORDER BY n_name) || ']' AS names FROM nation GROUP BY 1""")
def json_tags(t: Tables) -> DataFrame:
    return agg.labels_by_group(t.nation, "n_regionkey", "n_name", "names").withColumnRenamed("n_regionkey", "region")


@query("q_weighted_avg", "A25 A28 F40", """
    SELECT l_returnflag, floor(CAST(sum(CAST(l_discount * l_quantity AS DECIMAL(18,4))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) * 10000.0 + 0.5) / 10000.0 AS weighted_mean, count(*) AS n
    FROM lineitem GROUP BY 1""")
def weighted_avg(t: Tables) -> DataFrame:
    return agg.weighted_mean(t.lineitem, ["l_returnflag"], "l_discount", "l_quantity", 4)


@query("q_max_rank", "A26", """
    SELECT o_custkey, arg_max(o_orderstatus, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 WHEN 'F' THEN 3 ELSE 0 END) AS highest FROM orders GROUP BY 1""")
def max_rank(t: Tables) -> DataFrame:
    return agg.highest_by_rank(t.orders, ["o_custkey"], "o_orderstatus", ["O", "P", "F"])


@query("q_sample_estimate", "A27 S10", """
    SELECT count(*) AS sampled, count(*) FILTER (WHERE o_orderstatus = 'F') AS matching, CAST(floor(count(*) FILTER (WHERE o_orderstatus = 'F') / greatest(count(*), 1) * 1000000 + 0.5) AS BIGINT) AS estimate
    FROM (SELECT * FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 200)""")
def sample_estimate(t: Tables) -> DataFrame:
    # a sample by the order of a hash is the same on every run
    sample = t.orders.orderBy(F.md5(F.col("o_orderkey").cast("string")), "o_orderkey").limit(200)
    return agg.population_estimate(sample, F.col("o_orderstatus") == "F", 1_000_000)


@query("q_examples", "A30", """
    SELECT s.p_type, s.n, e.examples FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1) s JOIN (
        SELECT p_type, list(p_brand ORDER BY p_brand) AS examples FROM (SELECT p_type, p_brand, row_number() OVER (PARTITION BY p_type ORDER BY p_brand) AS r FROM part GROUP BY 1, 2) WHERE r <= 5 GROUP BY 1) e USING (p_type)""")
def examples_(t: Tables) -> DataFrame:
    return agg.examples(t.part, ["p_type"], "p_brand", 5)
