"""Queries on column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import keys, numbers, text
from corpusmill.plans.registry import Tables, query

_FOLD = "translate(lower({x}), 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿ', 'aaaaaaeeeeiiiiooooouuuuncyy')"
AS_OF = "1998-08-02 00:00:00"


@query("q_text_norm", "F1 F2 F3", f"""
    SELECT item_id, trim(regexp_replace(regexp_replace({_FOLD.format(x='text')}, '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm, {_FOLD.format(x='text')} AS lax,
        (SELECT count(DISTINCT w) FROM (SELECT unnest(regexp_split_to_array({_FOLD.format(x='text')}, '[^a-z0-9]+')) AS w) WHERE length(w) >= 4) AS n_tokens FROM benchmark""")
def text_norm(t: Tables) -> DataFrame:
    x = F.col("text")
    return t.benchmark.select("item_id", text.search_text(x).alias("norm"), text.fold(x).alias("lax"), F.size(text.tokens(x, 4)).cast("long").alias("n_tokens"))


@query("q_tags", "F4 F5 F18", f"""
    SELECT DISTINCT n_name, lower(regexp_replace(trim(n_name), '[.\\s]+$', '')) AS norm, upper(substr(n_name, 1, 1)) || substr(n_name, 2) || '.' AS display, regexp_replace(regexp_replace({_FOLD.format(x='n_name')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM nation""")
def tags(t: Tables) -> DataFrame:
    x = F.col("n_name")
    return t.nation.select("n_name", text.tag_norm(x).alias("norm"), text.tag_display(x).alias("display"), text.slug(x).alias("slug")).distinct()


@query("q_lev", "F6", """
    SELECT a.p_partkey AS a, b.p_partkey AS b, CAST(levenshtein(a.p_type, b.p_type) AS INT) AS distance, levenshtein(a.p_name, b.p_name) <= 3 AS near FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def lev(t: Tables) -> DataFrame:
    a = t.part.select(F.col("p_partkey").alias("a"), F.col("p_type").alias("ta"), F.col("p_name").alias("na"), (F.col("p_partkey") + 1).alias("b"))
    b = t.part.select(F.col("p_partkey").alias("b"), F.col("p_type").alias("tb"), F.col("p_name").alias("nb"))
    return a.join(b, "b").select("a", "b", F.levenshtein("ta", "tb").alias("distance"), (F.levenshtein("na", "nb", 3) >= 0).alias("near"))


@query("q_typo", "F7 F8", """
    SELECT n_name, CASE WHEN length(n_name) < 5 OR regexp_matches(n_name, '[0-9]') THEN n_name WHEN levenshtein(lower(n_name), 'nation1') <= 2 THEN 'nation1' WHEN levenshtein(lower(n_name), 'germani') <= 2 THEN 'germani' ELSE n_name END AS corrected,
        regexp_replace(regexp_replace(lower(n_name), '[_/]+', ' ', 'g'), '\\bnation\\b', 'country') AS light FROM nation""")
def typo(t: Tables) -> DataFrame:
    light = text.light_normalise(F.lower("n_name"), {"nation": "country"})
    return t.nation.select("n_name", text.autocorrect(F.col("n_name"), ["nation1", "germani"]).alias("corrected"), light.alias("light"))


@query("q_noise", "F11 F17 F20", """
    SELECT doc_id, length(trim(text)) < 140 OR len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) < 24 AS weak, CAST(ceil(length(text) / 4) AS BIGINT) AS token_estimate,
        CASE WHEN length(text) > 60 THEN rtrim(substr(text, 1, 60)) || '…' ELSE text END AS preview FROM documents""")
def noise(t: Tables) -> DataFrame:
    x = F.col("text")
    return t.documents.select("doc_id", text.weak(x, 140, 24).alias("weak"), text.token_estimate(x).alias("token_estimate"), text.preview(x, 60).alias("preview"))


@query("q_dates", "F30 F31 F33", f"""
    SELECT o_orderkey, CAST(regexp_extract('due ' || strftime(o_orderdate, '%Y-%m-%d') || ' or so', '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) AS DATE) AS found,
        floor(greatest(0.0, least(1.0, 1 - ((epoch(TIMESTAMP '{AS_OF}') - epoch(o_orderdate)) / 86400.0) / (365.25 * 6))) * 1000.0 + 0.5) / 1000.0 AS recency,
        CAST(year(o_orderdate) AS INT) AS year, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start FROM orders""")
def dates(t: Tables) -> DataFrame:
    ts = F.col("o_orderdate")
    noted = F.concat(F.lit("due "), F.date_format(ts, "yyyy-MM-dd"), F.lit(" or so"))
    return t.orders.select("o_orderkey", numbers.iso_date(noted).alias("found"), numbers.recency(ts, F.lit(AS_OF).cast("timestamp"), 6).alias("recency"), F.year(ts).alias("year"), numbers.month_start(ts).alias("month_start"))


@query("q_round", "F40 F47", """
    SELECT l_orderkey, l_linenumber, floor(l_discount * l_tax * 100.0 + 0.5) / 100.0 AS two, CASE WHEN l_discount * 10 >= 0.7 THEN 'high' WHEN l_discount * 10 >= 0.4 THEN 'medium' ELSE 'low' END AS level, greatest(0.0, least(1.0, l_quantity / 40)) AS clamped FROM lineitem""")
def round_(t: Tables) -> DataFrame:
    two = F.floor(F.col("l_discount") * F.col("l_tax") * 100.0 + 0.5) / 100.0
    return t.lineitem.select("l_orderkey", "l_linenumber", two.alias("two"), numbers.level(F.col("l_discount") * 10).alias("level"), numbers.clamp(F.col("l_quantity") / 40).alias("clamped"))


@query("q_norma_key", "F51 F53", """
    SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'codigo civil|' || p_size WHEN p_size % 5 = 1 THEN 'ley|' || p_partkey || '|' || p_size ELSE 'decreto|' || p_partkey || '|' || p_size || '|2004|-' END AS key,
        CAST(p_partkey AS VARCHAR) || 'N' || lpad(CAST(p_size % 100 AS VARCHAR), 2, '0') AS doc FROM part""")
def norma_key(t: Tables) -> DataFrame:
    m = F.col("p_size") % 5
    kind = F.when(m == 0, "Código  Civil").when(m == 1, "Ley").otherwise("Decreto")
    number = F.col("p_partkey").cast("string")
    key = keys.source_key(kind, number, F.col("p_size").cast("string"), F.when(m > 1, "2004"), F.lit(None).cast("string"))
    return t.part.select("p_partkey", key.alias("key"), keys.document_id(F.col("p_partkey"), F.col("p_size")).alias("doc"))


_STRIPPED = r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _name, _char in [*text.NAMED.items(), ("&amp;", "&")]:
    _STRIPPED = f"replace({_STRIPPED}, '{_name}', chr({ord(_char)}))"


@query("q_html", "F14", rf"SELECT page_id, length(trim(regexp_replace({_STRIPPED}, '\s+', ' ', 'g'))) AS n_chars, len(regexp_extract_all(html, '(?is)<tr\b[^>]*>.*?</tr>')) AS table_rows FROM pages")
def html(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.length(text.strip_html(F.col("html"))).alias("n_chars"), F.size(text.rows_of_cells(F.col("html"))).alias("table_rows"))


@query("q_refs", "F15 F16", """
    SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS number, CAST(year(o_orderdate) AS INT) AS year, 1 AS segments FROM orders""")
def refs(t: Tables) -> DataFrame:
    line = F.concat(F.lit("see 0"), F.col("o_custkey").cast("string"), F.lit("/"), F.date_format("o_orderdate", "yy"), F.lit("; applies "), F.col("o_custkey").cast("string"))
    return t.orders.select("o_orderkey", F.explode(text.reference_numbers(line)).alias("r"), F.size(text.segments(line, "applies|confirms")).alias("segments")).select("o_orderkey", "r.number", "r.year", "segments")


@query("q_json", "F42 F43 F44", """
    SELECT event_id, CAST(props->>'k' AS INT) AS k, props IS NOT NULL AS parsed FROM events""")
def json(t: Tables) -> DataFrame:
    reply = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n``` done"))
    payload = numbers.json_payload(reply)
    return t.events.select("event_id", F.get_json_object(payload, "$.k").cast("int").alias("k"), payload.isNotNull().alias("parsed"))


@query("q_fnv", "F22", """
    SELECT event_id, format('{:08x}', list_reduce(list_concat([CAST(2166136261 AS BIGINT)], list_transform(string_split(event_type || '|' || user_id, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) & 4294967295)) AS fingerprint FROM events""")
def fnv(t: Tables) -> DataFrame:
    return t.events.select("event_id", text.fnv1a(F.concat_ws("|", "event_type", F.col("user_id").cast("string"))).alias("fingerprint"))


@query("q_redact", "", """
    SELECT doc_id, regexp_matches(text, '\\b[0-9a-f]{32,}\\b|\\b\\d{13,19}\\b') AS had_secret FROM documents WHERE regexp_matches(text, '\\b[0-9a-f]{32,}\\b|\\b\\d{13,19}\\b')""")
def redact(t: Tables) -> DataFrame:
    # the text after redaction holds none of the values that it was searched for
    hit = F.col("text").rlike(r"\b[0-9a-f]{32,}\b|\b\d{13,19}\b")
    clean = ~text.redact(F.col("text")).rlike(r"\b[0-9a-f]{32,}\b|\b\d{13,19}\b")
    return t.documents.where(hit).select("doc_id", clean.alias("had_secret"))


@query("q_text_rules", "F9 F10 F12 F13 F19 F57", """
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[^0-9]', '', 'g') AS digits, s = '' OR length(s) > 90 OR (regexp_matches(s, '[;:,]') AND len(string_split(s, ' ')) > 8) OR starts_with(lower(s), 'and ') AS noisy,
        CASE WHEN doc_id % 3 = 0 THEN ['AB', 'XYZ'] WHEN doc_id % 3 = 1 THEN []::VARCHAR[] ELSE ['QRS'] END AS initials, CASE WHEN lang = 'en' THEN true WHEN lang = 'fr' THEN false END AS flag, trim(source || ' x') AS bare,
        trim(regexp_replace(replace(replace(first, 'the', 'a'), 'a ', 'an '), '\\s+', ' ', 'g')) AS replaced
    FROM (SELECT *, trim(regexp_replace(split_part(text, chr(10), 1), '\\s+', ' ', 'g')) AS s, lower(split_part(text, chr(10), 1)) AS first FROM documents)""")
def text_rules(t: Tables) -> DataFrame:
    first, m = F.split_part("text", F.lit("\n"), F.lit(1)), F.col("doc_id") % 3
    letters = F.when(m == 0, "AB, no, XYZ, AB, DEF").when(m == 1, "one two three").otherwise("QRS")
    said = F.when(F.col("lang") == "en", "Yes").when(F.col("lang") == "fr", " NO ").otherwise("maybe")
    return t.documents.select(
        "doc_id", text.digits(F.coalesce("text", F.lit(""))).alias("digits"), text.noisy_label(first, ["and "]).alias("noisy"), text.initials(letters, ["DEF"]).alias("initials"), text.flag(said).alias("flag"), text.strip_prefixes(F.concat(F.lit("  Title : "), "source", F.lit(" x")), ["title", "summary"]).alias("bare"),
        text.replace_in_order(F.lower(first), [("the", "a"), ("a ", "an ")]).alias("replaced"),
    )


@query("q_score_rules", "F41 F48 F35", """
    SELECT o_orderkey, CASE WHEN o_custkey % 3 <> 0 THEN o_totalprice / (o_custkey % 3) ELSE 0.0e0 END AS ratio, floor(least(1.0e0, log2(o_custkey % 40 + 1) / log2(17.0e0)) * 1000.0e0 + 0.5e0) / 1000.0e0 AS size, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE greatest(0.0e0, least(1.0e0, o_custkey % 5 / 3.0e0 - 0.3e0)) END AS score,
        (o_orderdate::DATE + 1)::TIMESTAMP AT TIME ZONE 'America/Santiago' AT TIME ZONE 'UTC' AS reset FROM orders""")
def score_rules(t: Tables) -> DataFrame:
    k = F.col("o_custkey")
    raw = F.when(k % 5 == 0, "n/a").otherwise((k % 5 / 3.0 - 0.3).cast("string"))
    noon = F.col("o_orderdate") + F.expr("INTERVAL 12 HOURS")
    return t.orders.select("o_orderkey", numbers.safe_ratio(F.col("o_totalprice"), k % 3).alias("ratio"), numbers.log_size(k % 40).alias("size"), numbers.score(raw).alias("score"), numbers.next_reset(noon, "America/Santiago").alias("reset"))


@query("q_redact_map", "", """
    SELECT event_id, '[redacted]' AS secret, CASE WHEN user_id % 2 = 0 THEN 'Authorization: [redacted]' ELSE 'key [redacted] ok ' || event_type END AS note, event_type AS plain FROM events""")
def redact_map(t: Tables) -> DataFrame:
    key = F.concat(F.lit("sk-"), F.lpad(F.col("event_id").cast("string"), 20, "a"))
    note = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("Authorization: "), F.lit("abc"))).otherwise(F.concat(F.lit("key "), key, F.lit(" ok "), "event_type"))
    m = text.redact_map(F.create_map(F.lit("API_KEY"), key, F.lit("note"), note, F.lit("kind"), F.col("event_type")))
    return t.events.select("event_id", m["API_KEY"].alias("secret"), m["note"].alias("note"), m["kind"].alias("plain"))


@query("q_document_id", "F54", """
    SELECT o_orderkey, CASE WHEN o_custkey % 3 > 0 AND o_orderkey % 4 > 0 THEN o_custkey || 'N' || strftime(o_orderdate, '%y') WHEN o_orderstatus = 'F' THEN 'F' || o_orderkey WHEN o_orderpriority = '1-URGENT' THEN o_orderpriority ELSE 'unknown' END AS doc FROM orders""")
def document_id(t: Tables) -> DataFrame:
    number, year = F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")), F.when(F.col("o_orderkey") % 4 > 0, F.year("o_orderdate"))
    first = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("F"), F.col("o_orderkey").cast("string")))
    second = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", keys.document_id(number, year, first, second).alias("doc"))
