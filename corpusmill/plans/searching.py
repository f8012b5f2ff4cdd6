"""Queries on searches in stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import search
from corpusmill.plans.registry import Tables, query

_PHRASES = ["not specified", "machinery urgent", "furniture", "specified not", "building low zzz", "x"]


@query("q_phrases", "P5", f"""
    WITH t AS (SELECT c_custkey, lower(c_mktsegment) AS x FROM customer UNION SELECT o_custkey, lower(o_orderpriority) FROM orders), p AS (SELECT unnest({_PHRASES}) AS phrase),
    w AS (SELECT phrase, unnest(list_filter(string_split(phrase, ' '), lambda v: length(v) > 1)) AS word FROM p), n AS (SELECT phrase, count(*) AS n FROM w GROUP BY 1 HAVING n > 1)
    SELECT phrase, c_custkey FROM t, p WHERE contains(x, phrase)
    UNION SELECT phrase, c_custkey FROM (SELECT DISTINCT phrase, word, c_custkey FROM t, w WHERE contains(x, word)) JOIN n USING (phrase) GROUP BY phrase, c_custkey, n HAVING count(*) = n""")
def phrases(t: Tables) -> DataFrame:
    labels = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return search.phrase_matches(t.customer, "c_custkey", labels, "o_orderpriority", _PHRASES, own="c_mktsegment")


@query("q_label_phrases", "P5", """
    SELECT phrase, p_brand FROM (SELECT DISTINCT p_brand, lower(p_type) AS label, lower(p_type) || '-kind' AS slug FROM part), (SELECT unnest(['economy', 'small-kind', 'promo standard']) AS phrase)
    WHERE contains(label, phrase) OR slug = phrase GROUP BY 1, 2
    UNION SELECT 'promo standard', p_brand FROM part GROUP BY p_brand HAVING count(*) FILTER (WHERE contains(lower(p_type), 'promo')) > 0 AND count(*) FILTER (WHERE contains(lower(p_type), 'standard')) > 0""")
def label_phrases(t: Tables) -> DataFrame:
    labels = t.part.select("p_brand", "p_type", F.concat(F.lower("p_type"), F.lit("-kind")).alias("slug")).distinct()
    return search.phrase_matches(labels.select("p_brand").distinct(), "p_brand", labels, "p_type", ["economy", "small-kind", "promo standard"], slug="slug")


_FOLD = "translate(lower({x}), 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿ', 'aaaaaaeeeeiiiiooooouuuuncyy')"


@query("q_late_lexical", "V2 F31", f"""
    WITH d AS (SELECT doc_id, TIMESTAMP '2020-01-01' + INTERVAL 1 DAY * (doc_id % 1500) AS ts, source, lang, substr(text, 1, 80) AS title, text FROM documents),
    n AS (SELECT *, floor(greatest(0.0e0, least(1.0e0, 1 - (epoch(TIMESTAMP '2024-03-01') - epoch(ts)) / 86400.0e0 / (365.25e0 * 4))) * 100.0e0 + 0.5e0) / 100.0e0 * 0.35e0 AS recent, {_FOLD.format(x="concat_ws(' ', source, lang, title)")} AS short FROM d ORDER BY ts DESC, doc_id LIMIT 100),
    q AS (SELECT item_id, list_distinct_in_order[1:6] AS w FROM (SELECT item_id, list_filter(list_transform(list_zip(x, range(1, len(x) + 1)), lambda p: CASE WHEN list_position(x, p[1]) = p[2] THEN p[1] END), lambda v: length(v) >= 3) AS list_distinct_in_order FROM (SELECT item_id, regexp_split_to_array({_FOLD.format(x="text")}, '[^a-z0-9]+') AS x FROM benchmark))),
    a AS (SELECT item_id, w, n.*, floor((len(list_filter(w, lambda v: contains(short, v))) + recent) * 100.0e0 + 0.5e0) / 100.0e0 AS s FROM q, n WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY s DESC, ts DESC, doc_id) <= 40),
    b AS (SELECT item_id, doc_id, source, floor((len(list_filter(w, lambda v: contains(short || ' ' || {_FOLD.format(x="coalesce(text, '')")}, v))) + recent) * 100.0e0 + 0.5e0) / 100.0e0 AS score FROM a)
    SELECT item_id, doc_id, source, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, source NULLS FIRST, doc_id) AS INT) AS rank FROM b WHERE score > 0 QUALIFY rank <= 30""")
def late_lexical(t: Tables) -> DataFrame:
    ts = F.timestamp_add("DAY", (F.col("doc_id") % 1500).cast("int"), F.lit("2020-01-01").cast("timestamp"))
    short = t.documents.select("doc_id", ts.alias("ts"), "source", "lang", F.substring("text", 1, 80).alias("title"))
    return search.late_lexical(short, "doc_id", "ts", "source", F.concat_ws(" ", "source", "lang", "title"), t.documents.select("doc_id", "text"), F.col("text"), t.benchmark, "item_id", "text", F.lit("2024-03-01").cast("timestamp"))


_DOCS = """
    d AS (SELECT 'E' || doc_id || 'N' || (20 + doc_id % 5) AS id, CASE WHEN doc_id % 3 > 0 THEN 'E' || doc_id END AS number, CASE WHEN doc_id % 4 > 0 THEN 2020 + doc_id % 5 END AS year, CAST(DATE '2020-01-01' + INTERVAL 1 YEAR * CAST(doc_id % 5 AS INT) + INTERVAL 1 DAY * CAST(doc_id % 300 AS INT) AS DATE) AS date,
        CASE WHEN doc_id % 7 > 0 THEN source || ' in ' || lang END AS title, substr(text, 1, 40) AS summary, 'enriched' AS state, label, lang, embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id)"""
_SIM = "list_cosine_similarity(CAST(d.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


def _searched(t: Tables, lean: bool) -> DataFrame:
    """An id; a number that no id has; a text; a text whose division has no vectors; a text with a list, a range and its second page."""
    n = F.col("doc_id")
    id_ = F.concat(F.lit("E"), n.cast("string"), F.lit("N"), (20 + n % 5).cast("string"))
    date = F.date_add(F.make_date((2020 + n % 5).cast("int"), F.lit(1), F.lit(1)), (n % 300).cast("int"))
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    docs = t.documents.join(vectors.select("doc_id", "label"), "doc_id", "left").select(
        id_.alias("id"), F.when(n % 3 > 0, F.concat(F.lit("E"), n.cast("string"))).alias("number"), F.when(n % 4 > 0, 2020 + n % 5).cast("int").alias("year"), date.alias("date"),
        F.when(n % 7 > 0, F.concat_ws(" in ", "source", "lang")).alias("title"), F.substring("text", 1, 40).alias("summary"), F.lit("enriched").alias("state"), "label", "lang",
    )
    stored = vectors.where("label <> 3").select(F.concat(F.lit("E"), n.cast("string"), F.lit("N"), (20 + n % 5).cast("string")).alias("id"), F.col("embedding").alias("vector"))
    names = F.create_map(F.lit(1), F.lit("number"), F.lit(2), F.lit("text"), F.lit(4), F.lit("division"), F.lit(5), F.lit("page"))
    asked = t.embeddings.where("vec_id IN (1, 2, 4, 5)").select(names[F.col("vec_id").cast("int")].alias("request"), F.col("embedding").alias("vector"))
    since = lambda first, last: search.if_given(first, lambda v: F.col("date") >= v) & search.if_given(last, lambda v: F.col("date") <= v)
    requests = [
        search.Request("id", "e12n22", since(None, None)), search.Request("number", "99999999"), search.Request("text", "free words", search.one_of("lang", None)),
        search.Request("division", "in e", F.col("label") == 3), search.Request("page", "free", search.one_of("lang", "en, fr") & since("2021-01-01", "") & search.if_given(8, lambda v: F.col("label") <= v), page=2),
    ]
    return search.staged_search(requests, docs, stored, asked, lean=lean)


_STAGED = f"""
    WITH {_DOCS}, q AS (SELECT CASE vec_id WHEN 1 THEN 'number' WHEN 2 THEN 'text' ELSE 'page' END AS request, embedding FROM embeddings WHERE vec_id IN (1, 2, 5)),
    near AS (SELECT request, d.*, {_SIM} AS score, 'vector' AS found_by FROM d, q WHERE d.label <> 3 AND (request <> 'page' OR (d.lang IN ('en', 'fr') AND d.date >= DATE '2021-01-01' AND d.label <= 8))),
    literal AS (SELECT 'id' AS request, d.*, NULL AS score, 'literal' AS found_by FROM d WHERE contains(lower(id), 'e12n22') UNION ALL SELECT 'division', d.*, NULL, 'literal' FROM d WHERE label = 3 AND contains(lower(title), 'in') AND (contains(lower(title), 'e') OR contains(lower(id), 'e'))),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY request ORDER BY score DESC NULLS LAST, date DESC, id) AS INT) AS rank, count(*) OVER (PARTITION BY request) AS total FROM (FROM near UNION ALL FROM literal)),
    o AS (SELECT request, rank, id, coalesce(title, 'untitled') AS title, date, coalesce(number, substr(id, 1, 8)) AS number, CAST(coalesce(year, year(date)) AS INT) AS year, CASE WHEN found_by = 'vector' THEN coalesce(summary, '') ELSE '' END AS summary, CASE WHEN found_by = 'vector' THEN 'vectorized' ELSE state END AS state, found_by, total FROM r
        WHERE rank > CASE request WHEN 'page' THEN 10 ELSE 0 END AND rank <= CASE request WHEN 'page' THEN 20 ELSE 10 END)"""


@query("q_staged_search", "V17 P10 P13 P1 P7", f"{_STAGED} SELECT * FROM o")
def staged_search(t: Tables) -> DataFrame:
    return _searched(t, lean=False)


@query("q_staged_lean", "P16 V17", f"{_STAGED} SELECT request, rank, id, title, date FROM o")
def staged_lean(t: Tables) -> DataFrame:
    return _searched(t, lean=True)
