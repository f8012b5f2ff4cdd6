"""Queries on what older loads left: rows of the tables are given the forms that such loads have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import legacy
from corpusmill.plans.registry import Tables, query
from corpusmill.sources import tables

_KINDS = [" LEY ", "dto", "DS", "resolucion", "ctr", "Otro", "cpr", "Dfl"]
_NAMES = ["Ley", "Decreto", "Decreto Supremo", "Resolución", "Código del Trabajo", "Otro", "Constitución Política de la República", "DFL"]


def _at(names: list, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), (n + 1).cast("int"))


@query("q_canonical_sources", "F55", f"""
    WITH x AS (SELECT p_partkey, {_NAMES}[p_partkey % 8 + 1] AS kind, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' 1.' || p_partkey || '.0 ' WHEN 2 THEN 'E' || p_partkey || '.1' WHEN 3 THEN '.5a.' || p_size ELSE CAST(p_partkey AS VARCHAR) END AS number, p_size FROM part)
    SELECT p_partkey, kind, CASE WHEN kind IN ('Ley', 'Decreto', 'Decreto Supremo', 'Resolución', 'DFL') AND p_partkey % 5 <> 2 THEN replace(trim(number), '.', '') ELSE number END AS number, CASE WHEN p_size % 3 = 0 THEN CAST(1960 + p_size AS VARCHAR) WHEN p_size % 3 = 1 THEN CAST(1960 + p_size AS VARCHAR) || '.5' END AS year FROM x""")
def canonical_sources(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    number = F.when(k % 5 == 1, F.concat(F.lit(" 1."), k.cast("string"), F.lit(".0 "))).when(k % 5 == 2, F.concat(F.lit("E"), k.cast("string"), F.lit(".1"))).when(k % 5 == 3, F.concat(F.lit(".5a."), size.cast("string"))).when(k % 5 == 4, k.cast("string"))
    year = F.when(size % 3 == 0, F.concat((size + 1960).cast("string"), F.lit(".0"))).when(size % 3 == 1, F.concat((size + 1960).cast("string"), F.lit(".5")))
    rows = t.part.select("p_partkey", _at(_KINDS, k % 8).alias("kind"), number.alias("number"), year.alias("year"))
    return legacy.canonical_sources(rows, "kind", "number", "year")


_SAID = ["Compleméntase", "complementa", "Aclárase", "aclara", "RECONSIDÉRASE", "reconsidera", "altera", "alteró", "Confírmase", "confirmó", "reactiva", "Reactívase", "aplícase", "aplica"]
_MEANT = ["complemented", "complemented", "clarified", "clarified", "reconsidered", "reconsidered", "altered", "altered", "confirmed", "confirmed", "reactivated", "reactivated", "applied", "applied"]
_MINED = f"""
    WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, year(o_orderdate) AS y FROM orders), r AS (SELECT k AS src, {_MEANT}[k % 14 + 1] AS action, CAST(c + 1 AS VARCHAR) AS num, y FROM o UNION SELECT k, 'applied', CAST(k + 100000 AS VARCHAR), 1997 FROM o WHERE k % 3 = 0),
    same AS (SELECT CAST(c AS VARCHAR) AS num, y, min(k) AS dst FROM o GROUP BY 1, 2), q AS (SELECT DISTINCT num, y FROM r),
    part AS (SELECT q.num, q.y, min(o.k) AS dst FROM q JOIN o ON o.y = q.y AND contains(CAST(o.c AS VARCHAR), q.num) GROUP BY 1, 2), e AS (SELECT DISTINCT src, coalesce(s.dst, p.dst) AS dst, action FROM r LEFT JOIN same s USING (num, y) LEFT JOIN part p USING (num, y) WHERE coalesce(s.dst, p.dst) IS NOT NULL)"""


def _mined(t: Tables) -> tuple[DataFrame, DataFrame]:
    k, c, y = F.col("o_orderkey"), F.col("o_custkey"), F.year("o_orderdate")
    number = F.concat(F.lit(" el dictamen N° "), F.when(c + 1 >= 1000, F.format_string("%d.%03d", F.floor((c + 1) / 1000), (c + 1) % 1000)).otherwise((c + 1).cast("string")), F.lit(", de "), y.cast("string"))
    more = F.when(k % 3 == 0, F.concat(F.lit("; aplica N "), (k + 100_000).cast("string"), F.lit(" de 1997."))).otherwise(". Aclara esto\nN° 5 de 1999; ver N° 6 de 1998")
    docs = t.orders.select("o_orderkey", "o_custkey", y.alias("y"), F.concat(F.lit("Se "), _at(_SAID, k % 14), number, more).alias("text"))
    return legacy.historical_relations(docs, "o_orderkey", "text", "o_custkey", "y")


@query("q_mined_resolved", "G14 G11", f"{_MINED} SELECT * FROM e")
def mined(t: Tables) -> DataFrame:
    return _mined(t)[0]


@query("q_mined_flags", "G14 G12", f"{_MINED} SELECT dst, list_sort(list(DISTINCT action)) AS flags FROM e GROUP BY 1")
def mined_flags(t: Tables) -> DataFrame:
    return _mined(t)[1]


@query("q_recovered_tags", "Q20 K3", """
    WITH x AS (SELECT doc_id, unnest(['item ' || (doc_id % 10) || '. .', 'Ítem ' || lang || ' 2']) AS t FROM documents WHERE doc_id % 4 < 2), h AS (SELECT doc_id, 'Item ' || (doc_id % 10) || '.' AS tag FROM documents WHERE source LIKE '%e%' UNION ALL SELECT doc_id, 'plain' FROM documents)
    SELECT doc_id, tag FROM h UNION ALL (SELECT DISTINCT doc_id, upper(t[1]) || regexp_replace(t[2:], '[.\\s]+$', '') || '.' AS tag FROM x EXCEPT SELECT doc_id, tag FROM h)""")
def recovered_tags(t: Tables) -> DataFrame:
    n = F.col("doc_id")
    item = F.concat(F.lit("item "), (n % 10).cast("string"), F.lit(". ."))
    lists = F.when(n % 4 == 0, F.to_json(F.array(item, F.lit("no digit"), F.concat(F.lit("Ítem "), "lang", F.lit(" 2"))))).when(n % 4 == 1, F.to_json(F.array(F.concat(F.lit("Ítem "), "lang", F.lit(" 2")), item, item))).when(n % 4 == 2, '{"a": 1}').otherwise("12 no list")
    held = t.documents.where("source LIKE '%e%'").select("doc_id", F.concat(F.lit("Item "), (n % 10).cast("string"), F.lit(".")).alias("tag")).unionByName(t.documents.select("doc_id", F.lit("plain").alias("tag")))
    return legacy.recovered_tags(t.documents.select("doc_id", lists.alias("json")), "doc_id", "json", held, "tag")


@query("q_empty_lists", "P9", """
    SELECT doc_id, doc_id % 6 IN (0, 1, 2) AS no_sources, trim(coalesce(text, '')) = '' OR lang = 'de' OR doc_id % 6 IN (0, 1) AS not_enriched FROM documents""")
def empty_lists(t: Tables) -> DataFrame:
    json = F.when(F.col("doc_id") % 6 == 1, "[]").when(F.col("doc_id") % 6 == 2, "[{}]").when(F.col("doc_id") % 6 == 3, "[ ]").when(F.col("doc_id") % 6 > 3, '[{"a":1}]')
    summary = F.when(F.col("lang") == "de", "  ").otherwise("a summary")
    return t.documents.select("doc_id", legacy.empty_list(json).alias("no_sources"), legacy.lacks_enrichment(F.col("text"), summary, F.lit("x"), json).alias("not_enriched"))


@query("q_newest_or_live", "S11 K7", """
    WITH l AS (SELECT year(o_orderdate) AS year, o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1, 2), s AS (SELECT year, label, n + 1 AS n FROM l WHERE year < 1998)
    SELECT 'early' AS asked, *, 'snapshot' AS origin FROM s WHERE year >= 1996 UNION ALL SELECT 'late', *, 'live' FROM l WHERE year >= 1999""")
def newest_or_live(t: Tables) -> DataFrame:
    """Two snapshots that stop at 1997: years before are read from the newer one, later years live."""
    live = t.orders.groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("n"))
    old = live.where("year < 1998")
    snapshots = old.withColumn("day", F.lit("1998-08-01")).unionByName(old.withColumn("n", F.col("n") + 1).withColumn("day", F.lit("1998-08-02")))
    ask = lambda name, where: legacy.newest_or_live(snapshots, "day", where, live.where(where)).withColumn("asked", F.lit(name))
    return ask("early", F.col("year") >= 1996).unionByName(ask("late", F.col("year") >= 1999)).select("asked", "year", "label", "n", "origin")


@query("q_kv_fallback", "S6", """
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'own ' || doc_id WHEN 1 THEN 'prefixed ' || doc_id WHEN 2 THEN 'own ' || doc_id END AS value FROM documents""")
def kv_fallback(t: Tables) -> DataFrame:
    """Values under a document's key, under the key with a prefix, under both and under neither."""
    k, m = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    own = t.documents.where(m.isin(0, 2)).select(k.alias("key"), F.concat(F.lit("own "), k).alias("value"))
    prefixed = t.documents.where(m.isin(1, 2)).select(F.concat(F.lit("doc:"), k).alias("key"), F.concat(F.lit("prefixed "), k).alias("value"))
    return tables.with_fallback(t.documents.select("doc_id", k.alias("key")), own.unionByName(prefixed), "key", "value", "doc:").select("doc_id", "value")


@query("q_inspected", "Q1 Q3", """
    WITH x AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN ' ' WHEN 1 THEN 'que se pronuncia sobre algo' ELSE source END AS matter, source = 'x' AS never, length(coalesce(text, '')) AS n, doc_id % 7 AS l FROM documents),
    y AS (SELECT *, trim(matter) = '' AS em, starts_with(matter, 'que ') AS na, l = 0 AS el, l = 1 OR l = 4 AS ge, l IN (2, 3, 4, 5) AS no, n < 200 AS ws, doc_id % 11 = 0 AS mm FROM x),
    z AS (SELECT *, list_filter([CASE WHEN em THEN 'empty_matter' END, CASE WHEN na THEN 'narrative_matter' END, CASE WHEN el THEN 'empty_labels' END, CASE WHEN ge THEN 'generic_labels' END, CASE WHEN no THEN 'label_noise' END, CASE WHEN doc_id % 13 = 0 THEN 'weak_title' END, CASE WHEN ws THEN 'weak_summary' END, CASE WHEN NOT em AND NOT na AND mm AND l <> 0 AND l <> 1 THEN 'matter_mismatch' END], lambda v: v IS NOT NULL) AS issues FROM y)
    SELECT doc_id, issues, list_sort(list_distinct(flatten(list_transform(issues, lambda i: CASE WHEN i LIKE '%_matter' THEN ['doctrine_lines', 'doctrine_clusters', 'cluster_label', 'dominant_theme', 'matter_evaluated'] WHEN i LIKE 'weak%' THEN ['key_documents', 'demo_titles', 'doctrine_search'] WHEN i = 'matter_mismatch' THEN ['doctrine_lines', 'doctrine_search', 'query_match_reason'] ELSE ['doctrine_search', 'query_match_reason'] END)))) AS areas,
        CASE WHEN em OR el OR n = 0 THEN 'blocking' WHEN na OR ge OR doc_id % 13 = 0 OR ws OR (mm AND l <> 1) THEN 'semantic_review' WHEN no THEN 'auto_normalizable' END AS bucket FROM z""")
def inspected(t: Tables) -> DataFrame:
    n = F.col("doc_id")
    lists = [[], ["General"], ["plazo_legal"], ["Plazo", "plazo "], ["varios", "a_b"], ["Uno", "uno"], ["fine", "other"]]
    labels = F.element_at(F.array(*[F.array(*map(F.lit, x)).cast("array<string>") for x in lists]), (n % 7 + 1).cast("int"))
    matter = F.when(n % 9 == 0, " ").when(n % 9 == 1, "que se pronuncia sobre algo").otherwise(F.col("source"))
    rows = t.documents.select("doc_id", matter.alias("matter"), F.lit("title").alias("title"), "text", F.lit("analysis").alias("analysis"), labels.alias("labels"))
    weak = {"weak_title": n % 13 == 0, "weak_summary": F.length(F.coalesce("text", F.lit(""))) < 200, "weak_analysis": F.lit(False)}
    out = legacy.inspected(rows, "matter", "title", "text", "analysis", "labels", ["general", "varios"], F.col("matter").startswith("que "), weak, n % 11 == 0)
    return out.select("doc_id", "issues", "areas", "bucket")
