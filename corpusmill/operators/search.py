"""Searches in stages: phrases over own text and labels, lexical search with late text, and ids, vectors, words in turn."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.numbers import recency
from corpusmill.functions.text import fold, tokens
from corpusmill.operators.aggregates import half_up
from corpusmill.operators.retrieval import cosine


def phrase_matches(docs: DataFrame, key: str, labels: DataFrame, label: str, phrases: list[str], own: str | None = None, slug: str | None = None) -> DataFrame:
    """``phrase`` and ``key`` of documents that hold a phrase, or all of its words of two letters or more.

    Phrase and words are looked for in the document's own text (if ``own`` is given) and in its related labels, without
    regard to case; words may be dealt over both. A label whose ``slug`` is the phrase counts too. Each text gives a mask of
    what it holds, the phrase at bit 0 and words above, and a document's masks are or-ed: one aggregate for all phrases,
    in which only texts that hold something take part.
    """

    def masks(rows: DataFrame, column: str, slug: str | None) -> DataFrame:
        low, found = F.lower(column), []
        for phrase in phrases:
            words = [w for w in phrase.split() if len(w) > 1][:62]
            whole = F.contains(low, F.lit(phrase.strip().lower()))
            whole = whole if slug is None else whole | F.col(slug).eqNullSafe(phrase.strip())
            bits = [F.when(whole, 1).otherwise(0), *[F.when(F.contains(low, F.lit(w.lower())), 2 << i).otherwise(0) for i, w in enumerate(words)]]
            all_words = (2 << len(words)) - 2 if len(words) > 1 else 0
            found.append(F.struct(F.lit(phrase).alias("phrase"), reduce(lambda a, b: a.bitwiseOR(b), [b.cast("long") for b in bits]).alias("mask"), F.lit(all_words).cast("long").alias("words")))
        return rows.select(key, F.explode(F.array(*found)).alias("m")).select(key, "m.*").where("mask <> 0")

    parts = [masks(labels, label, slug)] + ([masks(docs, own, None)] if own else [])
    met = reduce(DataFrame.unionByName, parts).groupBy("phrase", key, "words").agg(F.bit_or("mask").alias("mask"))
    hit = (F.col("mask").bitwiseAND(1) == 1) | ((F.col("words") > 0) & (F.col("mask").bitwiseAND(F.col("words")) == F.col("words")))
    found = met.where(hit).select("phrase", key)
    # labels may name documents that aren't there
    return found if own is None and docs is labels else found.join(docs.select(key), key, "left_semi").select("phrase", key)


def late_lexical(short: DataFrame, key: str, ts: str, order: str, short_text: Column, long: DataFrame, long_text: Column, queries: DataFrame, query: str, query_text: str, as_of: Column, limit: int = 5) -> DataFrame:
    """``query``, ``key``, ``order``, ``score`` and ``rank``: a lexical search in two stages over the newest documents.

    Of the newest ``20 * limit`` documents (120 at most) each query scores the first six of its words that the short text
    holds, and 0.35 of how recent the document is (four years); the best ``10 * limit`` (40) go on. Only for those are long
    texts read: their scan is filtered by the ids, which are as few as ``limit`` allows. They are scored again over both
    texts, and the best ``8 * limit`` (30) stay, ties by ``order`` and key.
    """
    newest, first, last = min(limit * 20, 120), min(limit * 10, 40), min(limit * 8, 30)
    recent = F.coalesce(recency(F.col(ts), as_of, 4, 2), F.lit(0.0)) * 0.35
    rows = short.orderBy(F.desc(ts), key).limit(newest).select(key, ts, order, fold(short_text).alias("_short"), recent.alias("_recent"))
    # one row of at most 120 documents
    held = rows.agg(F.collect_list(F.struct(*rows.columns)).alias("_rows"))
    asked = queries.select(query, F.slice(tokens(F.col(query_text), 3), 1, 6).alias("_tokens")).where(F.size("_tokens") > 0)
    score = lambda hay: half_up(F.size(F.filter("_tokens", lambda w: F.contains(hay, w))) + F.col("_recent"), 2)
    met = asked.crossJoin(F.broadcast(held)).select(query, "_tokens", F.explode("_rows").alias("_r")).select(query, "_tokens", "_r.*").withColumn("_score", score(F.col("_short"))).where("_score > 0")
    rank = lambda *by: F.row_number().over(Window.partitionBy(query).orderBy(*by))
    survivors = met.withColumn("_n", rank(F.desc("_score"), F.desc(ts), key)).where(F.col("_n") <= first)
    ids = [r[0] for r in rows.select(key).collect()]
    texts = long.where(F.col(key).isin(ids)).select(key, fold(long_text).alias("_long"))
    again = survivors.join(texts, key, "left").withColumn("score", score(F.concat_ws(" ", "_short", "_long"))).where("score > 0")
    return again.withColumn("rank", rank(F.desc("score"), order, key)).where(F.col("rank") <= last).select(query, key, order, "score", "rank")


def like_id(text: str) -> bool:
    """Whether a query looks like an id: letters and digits, N and digits; or a number of more than three digits."""
    return bool(re.fullmatch(r"(?i)[A-Z0-9]*[0-9]+N[0-9]+", text.strip()) or re.fullmatch(r"[0-9]{4,}", text.strip()))


def if_given(value, test) -> Column:
    """A filter that is only one where its parameter is given."""
    return F.lit(True) if value is None or value == "" else test(value)


def one_of(column: str, listed: str | None) -> Column:
    """A filter from a list with commas; blanks around names don't count."""
    return if_given(listed, lambda v: F.col(column).isin([x.strip() for x in v.split(",")]))


@dataclass(frozen=True)
class Request:
    """What is searched for: a text, a filter on attributes of documents, and a page."""

    name: str
    text: str
    where: Column | None = None
    page: int = 1


# The columns of a short answer and those that a full one has besides.
LEAN, FULL = ["request", "rank", "id", "title", "date"], ["number", "year", "summary", "state", "found_by", "total"]


def staged_search(requests: list[Request], docs: DataFrame, vectors: DataFrame, asked: DataFrame, size: int = 10, lean: bool = False) -> DataFrame:
    """Results of a few requests, each by the first of these stages that has any: its id, its vector, its words.

    ``docs`` has id, number, year, date, title, summary and state; ``vectors`` id and vector; ``asked`` the vectors of
    requests by name (``request``, ``vector``). A text like an id (``like_id``) that is part of an id or number goes straight
    to its words. Other requests take the nearest vectors; one with none goes on to its words, of which each of the first
    five has to be in title, number or id. Filters come before pages, in every stage. A short number is the id's first eight
    letters, a year that is missing the date's. ``total`` counts what all pages have. The stage that isn't needed isn't run.
    """
    ids = [r for r in requests if like_id(r.text)]
    part = lambda column, text: F.contains(F.lower(column), F.lit(text.strip().lower()))
    # one pass over the ids for all requests, one row back
    known = docs.agg(*[F.coalesce(F.bool_or(part("id", r.text) | part("number", r.text)), F.lit(False)).alias(f"_{i}") for i, r in enumerate(ids)]).first() if ids else ()
    literal = [r for r, there in zip(ids, known) if there]
    near = _nearest([r for r in requests if r not in literal], docs, vectors, asked)
    counts = {r["request"]: r["n"] for r in near.groupBy("request").agg(F.count("*").alias("n")).collect()} if near is not None else {}
    literal += [r for r in requests if r not in literal and not counts.get(r.name)]
    found = [x for x in (near, _literal(literal, docs)) if x is not None]
    rows = reduce(DataFrame.unionByName, found)
    order = Window.partitionBy("request").orderBy(F.desc_nulls_last("_score"), F.desc("date"), "id")
    page = F.create_map(*[x for r in requests for x in (F.lit(r.name), F.lit((r.page - 1) * size))])[F.col("request")]
    ranked = rows.withColumn("rank", F.row_number().over(order)).withColumn("total", F.count("*").over(Window.partitionBy("request")))
    shown = ranked.where((F.col("rank") > page) & (F.col("rank") <= page + size))
    return shown.select(*LEAN, *([] if lean else FULL))


def _projected(request: Column, score: Column, found_by: str) -> list[Column]:
    summary, state = (F.coalesce("summary", F.lit("")), F.lit("vectorized")) if found_by == "vector" else (F.lit(""), F.col("state"))
    return [
        request.alias("request"), F.col("id"), F.coalesce("number", F.substring("id", 1, 8)).alias("number"), F.coalesce(F.col("year"), F.year("date")).alias("year"), F.col("date"),
        F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("untitled")).alias("title"), summary.alias("summary"), state.alias("state"), F.lit(found_by).alias("found_by"), score.alias("_score"),
    ]


def _wanted(requests: list[Request], test) -> Column:
    """The names of the requests that a row passes, in one pass for all of them."""
    return F.explode(F.array_compact(F.array(*[F.when(test(r) & (r.where if r.where is not None else F.lit(True)), F.lit(r.name)) for r in requests])))


def _nearest(requests: list[Request], docs: DataFrame, vectors: DataFrame, asked: DataFrame) -> DataFrame | None:
    if not requests:
        return None
    rows = docs.join(vectors, "id").withColumn("_request", _wanted(requests, lambda r: F.lit(True)))
    # as many rows as there are requests
    q = F.broadcast(asked.where(F.col("request").isin([r.name for r in requests])).select(F.col("request").alias("_request"), F.col("vector").alias("_asked")))
    return rows.join(q, "_request").select(*_projected(F.col("_request"), cosine(F.col("vector"), F.col("_asked")), "vector"))


def _literal(requests: list[Request], docs: DataFrame) -> DataFrame | None:
    if not requests:
        return None
    low = [F.lower(F.col(c).cast("string")) for c in ("title", "number", "id")]
    has = lambda word: reduce(Column.__or__, [F.coalesce(F.contains(c, F.lit(word[:40].lower())), F.lit(False)) for c in low])
    words = lambda r: reduce(Column.__and__, [has(w) for w in r.text.split()[:5]], F.lit(True))
    return docs.withColumn("_request", _wanted(requests, words)).select(*_projected(F.col("_request"), F.lit(None).cast("double"), "literal"))
