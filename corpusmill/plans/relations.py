"""Queries on lookups, joins, pages and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import joins
from corpusmill.plans.registry import Tables, query


@query("q_lookup", "S1 S3 J21", "SELECT CAST(7 AS BIGINT) AS c_custkey, coalesce(max(c_name), 'unknown') AS c_name, coalesce(max(c_mktsegment), 'none') AS c_mktsegment FROM customer WHERE c_custkey = 7")
def lookup(t: Tables) -> DataFrame:
    return joins.point_lookup(t.customer.select("c_custkey", "c_name", "c_mktsegment"), "c_custkey", 7, {"c_name": "unknown", "c_mktsegment": "none"})


@query("q_exists", "S2 J4", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def exists(t: Tables) -> DataFrame:
    return joins.existing(t.documents.select("doc_id"), t.labels.where("quality = 1"), "doc_id")


@query("q_anti", "J6 J7 U3", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def anti(t: Tables) -> DataFrame:
    return joins.missing(t.documents.select("doc_id", "source"), t.labels.select("doc_id", F.col("quality").cast("string").alias("v")), "doc_id", ("v", "1"))


@query("q_exists_flag", "J5", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS has_partial FROM customer")
def exists_flag(t: Tables) -> DataFrame:
    return joins.flag_existing(t.customer.select("c_custkey"), t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "has_partial")


@query("q_search_sql", "P4 P6 P8 O1 O4", """
    WITH hits AS (SELECT p_partkey, p_name, p_brand, p_retailprice FROM part WHERE p_size >= 5 AND p_brand LIKE 'Brand#1%' AND (lower(p_name) LIKE '%e%' OR lower(p_type) LIKE '%e%') AND p_retailprice >= 950)
    SELECT *, (SELECT count(*) FROM hits) AS total, CAST(ceil((SELECT count(*) FROM hits) / 20) AS BIGINT) AS pages FROM hits ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 20""")
def search_sql(t: Tables) -> DataFrame:
    hits = t.part.where((F.col("p_size") >= 5) & F.col("p_brand").startswith("Brand#1") & joins.all_words(["p_name", "p_type"], "E") & (F.col("p_retailprice") >= 950))
    return joins.offset_page(hits.select("p_partkey", "p_name", "p_brand", "p_retailprice"), [F.desc("p_retailprice"), F.col("p_partkey")], 2, 20)


@query("q_edge_other", "J9 U1", """
    SELECT l_orderkey, l_suppkey, l_orderkey AS focus, l_suppkey AS other FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT s_suppkey FROM supplier)
    UNION ALL SELECT l_orderkey, l_suppkey, l_suppkey, l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey IN (SELECT s_suppkey FROM supplier)""")
def edge_other(t: Tables) -> DataFrame:
    edges = t.lineitem.where("l_returnflag = 'R'").select("l_orderkey", "l_suppkey")
    return joins.other_endpoint(edges, "l_orderkey", "l_suppkey", t.supplier, "s_suppkey")


@query("q_resolve_number", "J10 G11", """
    WITH refs AS (SELECT event_id, CAST(user_id AS VARCHAR) AS num, CAST(1994 AS INT) AS yr FROM events WHERE event_type = 'purchase'),
    d AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS n FROM orders WHERE year(o_orderdate) = 1994)
    SELECT event_id, num, yr, coalesce((SELECT min(o_orderkey) FROM d WHERE n = num), (SELECT min(o_orderkey) FROM d WHERE contains(n, num))) AS resolved FROM refs""")
def resolve_number(t: Tables) -> DataFrame:
    refs = t.events.where("event_type = 'purchase'").select("event_id", F.col("user_id").cast("string").alias("num"), F.lit(1994).alias("yr"))
    docs = t.orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    return joins.resolve_numbers(refs, "num", "yr", docs, "o_orderkey", "o_custkey", "y")


@query("q_overlap_ranges", "J15", """
    WITH a AS (SELECT c_custkey AS a_id, c_custkey * 10 AS s, c_custkey * 10 + c_nationkey AS e FROM customer), b AS (SELECT s_suppkey AS b_id, s_suppkey * 37 AS s, s_suppkey * 37 + s_nationkey AS e FROM supplier)
    SELECT a_id, b_id FROM a JOIN b ON a.s <= b.e AND a.e >= b.s""")
def overlap_ranges(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_custkey").alias("a_id"), (F.col("c_custkey") * 10).alias("start"), (F.col("c_custkey") * 10 + F.col("c_nationkey")).alias("end"))
    b = t.supplier.select(F.col("s_suppkey").alias("b_id"), (F.col("s_suppkey") * 37).alias("start"), (F.col("s_suppkey") * 37 + F.col("s_nationkey")).alias("end"))
    return joins.overlapping_ranges(a, b, 32)


@query("q_full_outer", "J16 Q14 V20", """
    SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.v AS left_value, l.v AS right_value,
        CASE WHEN l.doc_id IS NULL THEN 'only_left' WHEN d.doc_id IS NULL THEN 'only_right' WHEN d.v IS NOT DISTINCT FROM l.v THEN 'same' ELSE 'differs' END AS status
    FROM (SELECT doc_id, CAST(n_chars > 1500 AS INT) AS v FROM documents WHERE lang <> 'de') d FULL JOIN (SELECT doc_id, quality AS v FROM labels) l ON d.doc_id = l.doc_id""")
def full_outer(t: Tables) -> DataFrame:
    docs = t.documents.where("lang <> 'de'").select("doc_id", (F.col("n_chars") > 1500).cast("int").alias("v"))
    return joins.reconcile(docs, t.labels.select("doc_id", F.col("quality").alias("w")), "doc_id", "v", "w")


@query("q_first_wins", "U6", """
    SELECT id, text, min(p) AS source FROM (SELECT item_id AS id, text, 0 AS p FROM benchmark UNION ALL SELECT doc_id, text, 1 FROM documents UNION ALL SELECT conv_id, text, 2 FROM conversations) GROUP BY 1, 2""")
def first_wins(t: Tables) -> DataFrame:
    parts = [df.select(F.col(key).alias("id"), "text", F.lit(i).alias("source")) for i, (df, key) in enumerate([(t.benchmark, "item_id"), (t.documents, "doc_id"), (t.conversations, "conv_id")])]
    return joins.first_wins(parts, ["id", "text"])


@query("q_best_community", "J18 W1", """
    SELECT l_orderkey, p_brand, l_extendedprice FROM (SELECT l_orderkey, p_brand, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, p_brand, l_linenumber) AS r FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE r = 1""")
def best_community(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("p_partkey"), "l_extendedprice", "l_linenumber").join(t.part.select("p_partkey", "p_brand"), "p_partkey")
    return joins.best_per_key(lines, ["l_orderkey"], [F.desc("l_extendedprice"), F.col("p_brand"), F.col("l_linenumber")]).select("l_orderkey", "p_brand", "l_extendedprice")


@query("q_union_edges", "U1 U2 J17", """
    SELECT id, 'out' AS direction, count(*) AS n FROM (SELECT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'A') GROUP BY 1
    UNION ALL SELECT id, 'in', count(*) FROM (SELECT l_suppkey AS id FROM lineitem WHERE l_returnflag = 'A') GROUP BY 1""")
def union_edges(t: Tables) -> DataFrame:
    edges = t.lineitem.where("l_returnflag = 'A'")
    both = edges.select(F.col("l_orderkey").alias("id"), F.lit("out").alias("direction")).unionByName(edges.select(F.col("l_suppkey").alias("id"), F.lit("in").alias("direction")))
    return both.groupBy("id", "direction").agg(F.count("*").alias("n"))


@query("q_set_diff", "U3", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def set_diff(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id")).exceptAll(t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id")).distinct()).distinct()


@query("q_overlap_coeffs", "U4 F45 Q13", """
    WITH s AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS i FROM lineitem), p AS (SELECT o_orderkey AS a, o_orderkey + 1 AS b FROM orders),
    n AS (SELECT k, count(*) AS n FROM s GROUP BY 1), c AS (SELECT a, b, count(*) AS c FROM p JOIN s x ON x.k = a JOIN s y ON y.k = b AND y.i = x.i GROUP BY 1, 2),
    j AS (SELECT p.a, p.b, coalesce(c, 0) AS c, coalesce(x.n, 0) AS na, coalesce(y.n, 0) AS nb FROM p LEFT JOIN c ON p.a = c.a AND p.b = c.b LEFT JOIN n x ON x.k = p.a LEFT JOIN n y ON y.k = p.b)
    SELECT a, b, CAST(c AS BIGINT) AS common, CASE WHEN na + nb - c > 0 THEN floor(c / (na + nb - c) * 10000.0 + 0.5) / 10000.0 ELSE 0.0 END AS jaccard,
        CASE WHEN least(na, nb) > 0 THEN floor(c / least(na, nb) * 10000.0 + 0.5) / 10000.0 ELSE 0.0 END AS overlap FROM j""")
def overlap_coeffs(t: Tables) -> DataFrame:
    sets = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("i"))
    pairs = t.orders.select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 1).alias("b"))
    return joins.set_coefficients(sets, "k", "i", pairs)


@query("q_keyset", "O5 O8", """
    WITH page AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100) SELECT *, (SELECT max(o_orderkey) FROM page) AS next_cursor FROM page""")
def keyset(t: Tables) -> DataFrame:
    return joins.keyset_page(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 500, 100)


@query("q_recent_merge", "O6 O7", """
    SELECT kind, id, ts FROM (SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS ts FROM orders UNION ALL SELECT 'event', event_id, ts FROM events) ORDER BY ts DESC, kind, id LIMIT 30""")
def recent_merge(t: Tables) -> DataFrame:
    # each stream is cut to its own newest rows first
    top = lambda df: df.orderBy(F.desc("ts"), "kind", "id").limit(30)
    orders = t.orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"))
    events = t.events.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), "ts")
    return top(top(orders).unionByName(top(events)))


@query("q_suggest", "V18", "SELECT DISTINCT p_type AS suggestion FROM part WHERE contains(lower(p_type), 'eco') ORDER BY 1 LIMIT 10")
def suggest(t: Tables) -> DataFrame:
    return joins.suggest(t.part, "p_type", "Eco")


@query("q_fuzzy_lookup", "J11", """
    WITH t AS (SELECT DISTINCT c_name AS term FROM customer), v AS (SELECT DISTINCT substr(c_name, 1, 16) || substr(c_name, 18, 1) || substr(c_name, 17, 1) AS match FROM customer),
    n AS (SELECT term, match, levenshtein(term, match) AS d FROM t JOIN v ON substr(term, 1, 4) = substr(match, 1, 4) AND regexp_replace(term, '[^0-9]', '', 'g') = regexp_replace(match, '[^0-9]', '', 'g') WHERE abs(length(term) - length(match)) <= 3)
    SELECT t.term, b.match, CAST(b.d AS INT) AS distance FROM t LEFT JOIN (SELECT term, match, d, row_number() OVER (PARTITION BY term ORDER BY d, match) AS r FROM n WHERE d <= CASE WHEN length(term) > 10 THEN 2 ELSE 1 END) b ON t.term = b.term AND r = 1""")
def fuzzy_lookup(t: Tables) -> DataFrame:
    vocabulary = t.customer.select(F.concat(F.substring("c_name", 1, 16), F.substring("c_name", 18, 1), F.substring("c_name", 17, 1)).alias("w"))
    return joins.fuzzy_lookup(t.customer, "c_name", vocabulary, "w")


@query("q_similar_terms", "J13 W10", """
    WITH w AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS t FROM benchmark), p AS (SELECT t, row_number() OVER (ORDER BY t) AS r FROM w WHERE regexp_matches(t, '^[a-z0-9]+$'))
    SELECT x.t AS a, y.t AS b, CAST(levenshtein(x.t, y.t) AS INT) AS distance FROM p x JOIN p y ON y.r - x.r BETWEEN 1 AND 39
    WHERE regexp_replace(x.t, '[^0-9]', '', 'g') = regexp_replace(y.t, '[^0-9]', '', 'g') AND levenshtein(x.t, y.t) <= CASE WHEN least(length(x.t), length(y.t)) >= 15 THEN 3 WHEN least(length(x.t), length(y.t)) >= 8 THEN 2 ELSE 1 END""")
def similar_terms(t: Tables) -> DataFrame:
    words = t.benchmark.select(F.explode(F.split(F.lower("text"), " ")).alias("t")).where(F.col("t").rlike("^[a-z0-9]+$"))
    return joins.sorted_neighbours(words, "t")


@query("q_length_band", "J12", """
    WITH w AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS t FROM benchmark), p AS (SELECT t, length(t) AS n FROM w WHERE regexp_matches(t, '^[a-z0-9]+$') AND length(t) >= 4)
    SELECT x.t AS a, y.t AS b, CAST(levenshtein(x.t, y.t) AS INT) AS distance FROM p x JOIN p y ON y.n - x.n BETWEEN 0 AND 3 AND (x.n < y.n OR x.t < y.t)
    WHERE levenshtein(x.t, y.t) <= CASE WHEN x.n > 15 THEN 3 WHEN x.n > 8 THEN 2 ELSE 1 END""")
def length_band(t: Tables) -> DataFrame:
    words = t.benchmark.select(F.explode(F.split(F.lower("text"), " ")).alias("t")).where(F.col("t").rlike("^[a-z0-9]+$"))
    return joins.similar_by_length(words, "t")


@query("q_temporal_pairs", "J14", """
    SELECT a.o_custkey, a.o_orderkey AS src, b.o_orderkey AS dst FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND (a.o_orderdate, a.o_orderkey) < (b.o_orderdate, b.o_orderkey) WHERE NOT (a.o_orderkey + 1 = b.o_orderkey)""")
def temporal_pairs(t: Tables) -> DataFrame:
    edges = t.orders.select(F.col("o_orderkey").alias("src"), (F.col("o_orderkey") + 1).alias("dst"))
    return joins.temporal_pairs(t.orders, "o_custkey", "o_orderkey", "o_orderdate", edges).select("o_custkey", "src", "dst")
