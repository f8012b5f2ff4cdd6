"""Queries on doctrine lines. Customers are lines, their orders the documents; prices say how well a document fits a search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import joins, lines, metadata
from corpusmill.plans import metadata as described
from corpusmill.plans.registry import Tables, query

# what both engines read: documents of a line, and lines
_MEMBER = {"representative": "o_orderkey % 5 = 1", "pivot": "o_orderkey % 7 = 2", "recency": "(o_orderkey % 11) / 10.0e0", "subtopic": "(o_orderkey % 3) / 10.0e0", "reading_weight": "(o_orderkey % 13) / 13.0e0", "currentness": "(o_orderkey % 9) / 9.0e0", "current_state": "o_orderkey % 4 = 0"}
_LINE = {
    "status": "CASE c_custkey % 3 WHEN 0 THEN 'in_review' WHEN 1 THEN 'strained' ELSE 'stable' END", "active": "(c_custkey % 11) / 10.0e0", "importance": "(c_custkey % 7) / 7.0e0", "risk": "(c_custkey % 5) / 5.0e0", "priority": "(c_custkey % 6) / 6.0e0",
    "intent": "(c_custkey % 4) * 0.3e0", "subtopic": "(c_custkey % 2) * 0.4e0", "currentness": "(c_custkey % 9) / 9.0e0", "reading_weight": "(c_custkey % 13) / 13.0e0", "centrality": "(c_custkey % 8) / 8.0e0",
}
_HITS = "h AS (SELECT o_orderkey AS k, o_totalprice / 600000.0e0 AS norm, o_totalprice AS raw, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders WHERE o_orderstatus <> 'P')"
_LINES = f"l AS (SELECT c_custkey, {', '.join(f'{e} AS {n}' for n, e in _LINE.items())} FROM customer)"


def _hits(t: Tables) -> DataFrame:
    found = t.orders.where("o_orderstatus <> 'P'").select("o_orderkey", (F.col("o_totalprice") / 600000.0).alias("norm"), F.col("o_totalprice").alias("raw"))
    return joins.numbered(found, [F.desc("raw"), F.col("o_orderkey")], "rank")


def _lines(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", *[F.expr(e).alias(n) for n, e in _LINE.items()])


def _members(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", *[F.expr(e).alias(n) for n, e in _MEMBER.items()])


_HYBRID = f"""{_HITS}, {_LINES}, m AS (SELECT o_custkey AS c, norm, rank, {_MEMBER["representative"]} AS own, row_number() OVER (PARTITION BY o_custkey ORDER BY norm DESC, rank) AS r FROM orders JOIN h ON k = o_orderkey),
    g AS (SELECT c, max(norm) AS pk, CAST(sum(CAST(norm AS DECIMAL(20,8))) FILTER (WHERE r <= 3) AS DOUBLE) AS three, coalesce(max(norm) FILTER (WHERE own), 0.0e0) AS own, min(rank) = 1 AS top FROM m GROUP BY 1),
    s AS (SELECT l.*, floor(CASE WHEN pk IS NULL THEN importance * 0.2e0 ELSE pk * 4.2e0 + own * 1.6e0 + three * 1.25e0 + CASE WHEN top THEN 2.4e0 ELSE 0.0e0 END + intent + subtopic + priority * 0.55e0 + importance * 0.25e0
        + (CASE status WHEN 'in_review' THEN 0.2e0 ELSE 0.0e0 END + CASE status WHEN 'strained' THEN 0.12e0 ELSE 0.0e0 END + active * 0.4e0 + currentness * 0.45e0) + risk * 0.3e0 + reading_weight * 0.7e0 + centrality * 0.55e0 END * 10000.0e0 + 0.5e0) / 10000.0e0 AS hybrid FROM l LEFT JOIN g ON c = c_custkey)"""


@query("q_line_scores", "V12", f"WITH {_HYBRID} SELECT c_custkey, hybrid FROM s")
def line_scores(t: Tables) -> DataFrame:
    return lines.line_scores(_lines(t), _members(t).select("c_custkey", "o_orderkey", "representative"), _hits(t), "c_custkey", "o_orderkey").select("c_custkey", "hybrid")


_ANCHORS = f"""m AS (SELECT o_custkey AS c, o_orderkey AS k, {", ".join(f'{e} AS "{n}"' for n, e in _MEMBER.items())} FROM orders),
    x AS (SELECT m.*, norm, raw, rank, l.active, l.risk FROM m LEFT JOIN h ON h.k = m.k JOIN l ON c_custkey = c),
    f AS (SELECT *, floor((norm * 1.15e0 + recency * (active * 0.45e0 + risk * 0.2e0) + CASE WHEN "pivot" THEN 0.12e0 ELSE 0.0e0 END + subtopic * 0.45e0 + reading_weight * 0.55e0 + currentness * 0.35e0 + CASE WHEN current_state THEN 0.18e0 ELSE 0.0e0 END) * 1000000.0e0 + 0.5e0) / 1000000.0e0 AS fit FROM x WHERE norm IS NOT NULL),
    b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY c ORDER BY fit DESC, raw DESC, rank, k) = 1), o AS (SELECT c, min(k) AS ok, coalesce(max(norm), 0.0e0) AS onorm, max(recency) AS orec FROM x WHERE representative GROUP BY 1),
    p AS (SELECT b.*, ok, k IS DISTINCT FROM ok AND (norm >= 0.9e0 OR norm - coalesce(onorm, 0.0e0) >= 0.18e0 OR (active >= 0.55e0 AND recency - coalesce(orec, 0.0e0) >= 0.22e0 AND norm - coalesce(onorm, 0.0e0) >= -0.04e0)) AS promoted FROM b LEFT JOIN o ON o.c = b.c)"""


@query("q_line_anchors", "V13", f"WITH {_HITS}, {_LINES}, {_ANCHORS} SELECT c AS c_custkey, k AS anchor, fit, recency AS anchor_recency, promoted, CASE WHEN promoted THEN k ELSE coalesce(ok, k) END AS representative FROM p")
def line_anchors(t: Tables) -> DataFrame:
    return lines.anchors(_lines(t), _members(t), _hits(t), "c_custkey", "o_orderkey")


@query("q_ranked_lines", "V12 W7", """
    WITH l AS (SELECT c_custkey, c_nationkey AS fam, (c_custkey % 17) / 4.0e0 AS hybrid, CASE c_custkey % 3 WHEN 0 THEN 'in_review' WHEN 1 THEN 'strained' ELSE 'stable' END AS status, (c_custkey % 11) / 10.0e0 AS active, (c_custkey % 10) / 9.0e0 AS rec, (c_custkey % 9) / 9.0e0 AS cur, (c_custkey % 13) / 13.0e0 AS rw FROM customer WHERE c_acctbal > 0),
    s AS (SELECT *, floor((hybrid + (CASE status WHEN 'in_review' THEN 0.35e0 ELSE 0.0e0 END + CASE status WHEN 'strained' THEN 0.18e0 ELSE 0.0e0 END + active * 0.45e0 + rec * 0.35e0 - CASE WHEN active < 0.2e0 AND rec < 0.35e0 THEN 0.45e0 ELSE 0.0e0 END)) * 10000.0e0 + 0.5e0) / 10000.0e0 AS presentation,
        floor((CASE status WHEN 'in_review' THEN 0.9e0 ELSE 0.0e0 END + CASE status WHEN 'strained' THEN 0.5e0 ELSE 0.0e0 END + active * 1.35e0 + rec * 1.1e0 + cur * 1.15e0 + rw * 0.7e0) * 10000.0e0 + 0.5e0) / 10000.0e0 AS now FROM l),
    f AS (SELECT *, max(now) OVER (PARTITION BY fam) AS lead, active < 0.25e0 AND rec < 0.45e0 AS historical FROM s),
    r AS (SELECT *, floor((presentation + CASE WHEN lead < 1.8e0 THEN 0.0e0 WHEN now >= lead - 0.18e0 THEN 0.55e0 WHEN historical THEN -0.95e0 ELSE -0.25e0 END) * 10000.0e0 + 0.5e0) / 10000.0e0 AS ranked FROM f)
    SELECT c_custkey, hybrid, presentation, ranked, historical, CASE WHEN historical THEN least(ranked, (SELECT min(ranked) FROM r WHERE active >= 0.5e0 AND rec >= 0.6e0 AND status <> 'stable')) ELSE ranked END AS order_score FROM r""")
def ranked_lines(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    known = _lines(t).select("c_custkey", "status", "active", "currentness", "reading_weight", (k % 17 / 4.0).alias("hybrid"), (k % 10 / 9.0).alias("anchor_recency"))
    return lines.ranked_lines(known.join(t.customer.where("c_acctbal > 0").select("c_custkey", "c_nationkey"), "c_custkey"), "c_custkey", "c_nationkey").drop("c_nationkey")


_WORDS, _TOPIC = ["the", "there", "thing"], ["and", "of"]


def _constrained(sure: bool) -> str:
    both = [*_WORDS, *_TOPIC]
    n = lambda words, where: f"len(list_filter({words}, lambda x: list_contains({where}, x)))"
    held = lambda words: f"least(2, len(list_filter(p, lambda y: len(list_filter({words}, lambda x: contains(y, x))) >= 2)))"
    words = "list_distinct(string_split_regex(lower(strip_accents({})), '[^a-z0-9]+'))"
    strict = "q + s >= 2 AND ca >= 1" if sure else "(q >= 2 AND cq >= 1) OR (q + s >= 2 AND ca >= 1 AND NOT (q = 0 AND regexp_matches(array_to_string(p, ' '), '\\b(decreto|presidencia|presidenciales|acto|actos)\\b'))) OR score >= 1.05e0"
    if sure:
        strict += " AND (q >= 2 OR s >= 2 OR (q >= 1 AND s >= 1) OR score >= 1.15e0)"
    return f"""
    WITH t AS (SELECT doc_id, {words.format("text")} AS w, list_transform(string_split(text, chr(10)), lambda x: lower(strip_accents(x))) AS p, {words.format("string_split(text, chr(10))[1]")} AS ti, {words.format("lang || ' ' || source")} AS ta FROM documents),
    c AS (SELECT *, {n(_WORDS, "w")} AS q, {n(_TOPIC, "w")} AS s, {held(_WORDS)} AS cq, {held(both)} AS ca, least(2, {n(both, "ti")}) AS nt, least(2, {n(both, "ta")}) AS na FROM t),
    d AS (SELECT *, floor((q / {len(_WORDS)} * 1.55e0 + s / {len(_TOPIC)} * 1.25e0 + cq * 0.32e0 + ca * 0.28e0 + nt * 0.3e0 + na * 0.22e0 + least(3, q + s) * 0.18e0) * 1000.0e0 + 0.5e0) / 1000.0e0 AS score FROM c),
    e AS (SELECT *, {strict} AS strict, score >= {0.95 if sure else 0.8}e0 AND q + s >= 1 AND ca >= 1 AS weak FROM d)
    SELECT doc_id, score, q + s AS anchors, q AS in_query, s AS in_subtopic, strict FROM e WHERE strict OR (weak AND NOT (SELECT coalesce(bool_or(strict), false) FROM e))"""


def _as_lines(t: Tables) -> DataFrame:
    parts = F.split("text", "\n")
    return t.documents.select("doc_id", parts[0].alias("title"), parts.alias("segments"), F.array("lang", "source").alias("tags"))


@query("q_constrained_lines", "V14", _constrained(False))
def constrained_lines(t: Tables) -> DataFrame:
    return lines.constrained_lines(_as_lines(t), "doc_id", "title", "tags", "segments", _WORDS, _TOPIC, False)


@query("q_constrained_sure", "V14", _constrained(True))
def constrained_sure(t: Tables) -> DataFrame:
    return lines.constrained_lines(_as_lines(t), "doc_id", "title", "tags", "segments", _WORDS, _TOPIC, True)


_SAID = ["criterio", "nuevo", "regla"]
_TOLD = " + ".join(f"CASE WHEN contains(low, '{n}') THEN 1 ELSE 0 END" for n in lines.NEEDLES)
_SIGNALS = ", ".join(f"len(list_filter({ps}, lambda x: contains(txt, x))) AS n{i}" for i, (_, ps) in enumerate(lines.STATUS.values()))


@query("q_matter_status", "V15", f"""
    WITH {described._SCORED}, md AS (SELECT *, {described._unit(f"rd * 0.24e0 + 0.28e0 + {described._if('has_source', 0.08)} + {described._if('has_topic', 0.08)} + least(0.16e0, len(secondary) * 0.04e0) + least(0.16e0, (len(s_abstention) + len(s_litigious) + len(s_operational)) * 0.04e0)")} AS conf,
        {described._unit(f"centrality * 0.34e0 + currentness * 0.26e0 + historical * 0.18e0 + shift * 0.12e0 + {described._if(described._ENTRY, 0.1)}")} AS rw FROM g),
    r1 AS (SELECT o.o_orderkey AS k, o_orderdate AS ts, lower(coalesce(body, '')) AS low, {described._FOLDED} AS txt FROM orders o JOIN i ON i.o_orderkey = o.o_orderkey),
    r2 AS (SELECT *, {_TOLD} AS told, len(list_filter({_SAID}, lambda w: contains(txt, w))) AS n FROM r1 WHERE {" OR ".join(f"contains(low, '{w}')" for w in _SAID)} ORDER BY told DESC, ts DESC NULLS LAST, k LIMIT 200),
    r3 AS (SELECT *, {_SIGNALS} FROM r2 WHERE n / {len(_SAID)} >= 0.45e0 ORDER BY told DESC, ts DESC NULLS LAST, k LIMIT 40),
    r4 AS (SELECT *, CASE WHEN n0 + n1 + n2 = 0 THEN NULL WHEN n0 * 1.5e0 >= n1 * 1.45e0 AND n0 * 1.5e0 >= n2 * 1.05e0 THEN struct_pack(v := 1.5e0 + (n0 - 1) * 0.25e0, nm := 'abstention') WHEN n1 * 1.45e0 >= n2 * 1.05e0 THEN struct_pack(v := 1.45e0 + (n1 - 1) * 0.25e0, nm := 'litigious') ELSE struct_pack(v := 1.05e0 + (n2 - 1) * 0.25e0, nm := 'change_of_regime') END AS sg FROM r3),
    r5 AS (SELECT k, ts, n, contains(txt, 'nuevo criterio')::INT AS ph, (n >= 2)::INT AS coh, sg, md.*, greatest(0.0e0, date_diff('day', ts, TIMESTAMP '1998-08-02') / 365.25e0) AS age FROM r4 JOIN md ON md.o_orderkey = k),
    r6 AS (SELECT *, floor((n / {len(_SAID)} * 1.75e0 + ph * 0.8e0 + coh * 0.55e0 + coalesce(sg.v, 0.0e0) + greatest(0.0e0, 1.2e0 - least(1.2e0, age * 0.18e0)) + {" + ".join(described._if(x, w) for x, w in [("bulletin", 0.18), ("reactivated", 0.14), ("applied", 0.08), ("complemented", 0.05), ("confirmed", 0.06)])}
        + currentness * 1.4e0 + rw * 0.95e0 + centrality * 0.45e0 + {described._if("supports", 0.24)} - {described._if("ab AND sg IS NULL", 0.2)} - {described._if("k = 7", 0.2)}) * 1000.0e0 + 0.5e0) / 1000.0e0 AS score FROM r5 WHERE n >= 2 AND (ph >= 1 OR coh >= 1) AND (sg IS NOT NULL OR currentness >= 0.62e0 OR supports)),
    r7 AS (SELECT * FROM r6 ORDER BY score DESC, ts DESC NULLS LAST, k LIMIT 1)
    SELECT k AS o_orderkey, score, coalesce(sg.nm, CASE WHEN ab THEN 'abstention' WHEN li THEN 'litigious' WHEN cl THEN 'change_of_regime' ELSE 'current_rule' END) AS category, greatest(0.55e0, least(0.98e0, floor((score + conf) / 5.1e0 * 100.0e0 + 0.5e0) / 100.0e0)) AS confidence FROM r7 WHERE score >= 2.45e0""")
def matter_status(t: Tables) -> DataFrame:
    known = metadata.document_metadata(described._documents(t)).select("o_orderkey", "bulletin", "reactivated", "applied", "complemented", "confirmed", "currentness", "reading_weight", "centrality", "supports", "abstains", "litigious", "closes_competence", "confidence")
    docs = t.orders.select("o_orderkey", "o_orderdate", F.expr(described._INPUT["body"]).alias("body"))
    return lines.matter_status(docs, "o_orderkey", ["body"], "o_orderdate", known, _SAID, ["nuevo criterio"], F.lit("1998-08-02").cast("date"), 7)
