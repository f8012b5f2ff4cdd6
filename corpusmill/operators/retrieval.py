"""Lexical, vector and hybrid retrieval over documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import tokens
from corpusmill.operators.aggregates import half_up


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def valid_vector(v: Column, size: int) -> Column:
    """Whether a vector has so many components, all finite."""
    return v.isNotNull() & (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def similar(vectors: DataFrame, query: DataFrame, key: str, vector: str, k: int, where: Column | None = None, digits: int = 4) -> DataFrame:
    """The k most similar rows to a query vector (one row), after a filter on their attributes; ties go to the smaller key."""
    rows = vectors.where(where) if where is not None else vectors
    q = query.select(F.col(vector).alias("_q")).limit(1)
    scored = rows.crossJoin(F.broadcast(q)).select(key, cosine(F.col(vector), F.col("_q")).alias("_raw"))
    # by the whole score, which is only shown in few digits
    return scored.orderBy(F.desc("_raw"), key).limit(k).select(key, half_up(F.col("_raw"), digits).alias("score"))


def lexical(docs: DataFrame, key: str, text: str, queries: DataFrame, query: str, query_text: str, k: int, least: int = 4) -> DataFrame:
    """The k documents that cover most of each query's words, by an inverted index: words meet in an equality join.

    Coverage is the share of a query's words that the document has (4 digits). Only words that queries ask for are
    counted; a word has the queries that ask for it beside it, and what a document adds to each is summed before the shuffle.
    """
    q = queries.select(F.col(query), tokens(F.col(query_text), least).alias("_w")).withColumn("_words", F.size("_w"))
    asked = q.select(query, "_words", F.explode("_w").alias("word"))
    index = docs.select(F.col(key), F.explode(tokens(F.col(text), least)).alias("word"))
    hits = index.join(asked, "word").groupBy(query, key).agg(F.count("*").alias("hits"), F.max("_words").alias("_words"))
    scored = hits.withColumn("coverage", half_up(F.col("hits") / F.col("_words"), 4))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("coverage"), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(query, key, "hits", "coverage", "rank")


def hybrid(semantic: DataFrame, lexical_: DataFrame, key: str) -> DataFrame:
    """Both lists in one: 1.15 * (score / best) + 0.25 for semantic hits, with 0.85 * lexical where both have a row; 0.95 * lexical + 0.08 alone."""
    # one row
    best = semantic.agg(F.nullif(F.max("score"), F.lit(0.0)).alias("_best"))
    s = semantic.crossJoin(F.broadcast(best)).select(key, F.coalesce(F.col("score") / F.col("_best"), F.lit(0.0)).alias("_s"))
    both = s.join(lexical_.select(key, F.col("score").alias("_l")), key, "full_outer")
    value = F.when(F.col("_s").isNull(), F.col("_l") * 0.95 + 0.08).otherwise(F.col("_s") * 1.15 + 0.25 + F.coalesce(F.col("_l") * 0.85, F.lit(0.0)))
    return both.select(key, half_up(value, 4).alias("score"), F.when(F.col("_s").isNull(), "lexical").when(F.col("_l").isNull(), "semantic").otherwise("both").alias("found_by"))


def dual(original: DataFrame, rewritten: DataFrame, key: str, top: int = 3) -> DataFrame:
    """Results of a query and of its rewriting in one: the better of score and 0.93 of the other's, 0.08 more for both, 0.04 for the first places."""
    first = original.orderBy(F.desc("score"), key).limit(top).select(key, F.lit(True).alias("_first"))
    o = original.select(key, F.col("score").alias("_o")).join(F.broadcast(first), key, "left")
    both = o.join(rewritten.select(key, F.col("score").alias("_n")), key, "full_outer")
    value = F.greatest(F.coalesce("_o", F.lit(0.0)), F.coalesce(F.col("_n") * 0.93, F.lit(0.0))) + F.when(F.col("_o").isNotNull() & F.col("_n").isNotNull(), 0.08).otherwise(0.0) + F.when(F.col("_first"), 0.04).otherwise(0.0)
    return both.select(key, half_up(value, 4).alias("score"))


def accept_rewrite(original: Column, rewritten: Column) -> Column:
    """Whether a rewriting keeps a query: half of its words, all of its numbers, and a length between 0.45 and 3.2 of its own."""
    a, b = tokens(original, 3), tokens(rewritten, 3)
    kept = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))
    numbers = F.filter(F.split(original, r"\D+"), lambda x: x != "")
    ratio = F.length(rewritten) / F.greatest(F.length(original), F.lit(1))
    return (kept >= 0.5) & (F.size(F.array_except(numbers, F.split(rewritten, r"\D+"))) == 0) & ratio.between(0.45, 3.2)


def intent(text: Column, definitions: dict[str, tuple[str, list[str]]]) -> Column:
    """The intent whose phrases a text holds most of, with its confidence; (label, phrases) by name, earlier names win ties."""
    low = F.lower(text)
    has = lambda p: F.when(F.contains(low, F.lit(p)), 1.0).otherwise(0.0)
    scored = []
    for i, (name, (label, phrases)) in enumerate(definitions.items()):
        value = reduce(Column.__add__, [has(p) for p in phrases]) + has(label) * 1.2
        scored.append(F.struct(value.alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name")))
    best = F.greatest(*scored) if len(scored) > 1 else scored[0]
    return F.when(best["score"] > 0, F.struct(best["name"].alias("name"), half_up(F.greatest(F.lit(0.35), F.least(F.lit(0.92), best["score"] / 4.5)), 3).alias("confidence")))


def id_first(docs: DataFrame, key: str, text: str, query: str, n: int) -> DataFrame:
    """A search that looks for an id if the query is like one, else for all of its words; filters come before pages."""
    like_id = any(c.isdigit() for c in query) and sum(c.isdigit() for c in query) > 3
    if like_id:
        hit = F.col(key).cast("string").startswith("".join(c for c in query if c.isdigit()))
    else:
        hit = reduce(Column.__and__, [F.contains(F.lower(text), F.lit(w.lower())) for w in query.split()], F.lit(True))
    return docs.where(hit).orderBy(key).limit(n)


def family_score(segments: Column, title: Column, query: Column) -> Column:
    """1.55 * coverage by the segments + 0.30 for the title's words + 0.32 for each of the first segments with all words (at most 3)."""
    words = tokens(query, 3)
    share = lambda side: F.size(F.array_intersect(words, side)) / F.greatest(F.size(words), F.lit(1))
    all_segments = F.array_distinct(F.flatten(F.transform(segments, lambda s: tokens(s, 3))))
    full = F.size(F.filter(F.slice(segments, 1, 3), lambda s: F.size(F.array_except(words, tokens(s, 3))) == 0))
    return half_up(share(all_segments) * 1.55 + share(tokens(title, 3)) * 0.30 + full * 0.32, 3)


def rerank(hits: DataFrame, key: str, order: DataFrame, rank: str) -> DataFrame:
    """Hits in an order given from outside; those that it leaves out go."""
    return hits.join(order.select(key, F.col(rank).alias("new_rank")), key).orderBy("new_rank")


def store_drift(table: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """One row on how a vector store differs from its table: counts, missing either way, share, and how bad that is."""
    both = table.select(key, F.lit(1).alias("_t")).join(vectors.select(key, F.lit(1).alias("_v")), key, "full_outer")
    out = both.agg(F.count("_t").alias("in_table"), F.count("_v").alias("in_store"), F.count_if(F.col("_v").isNull()).alias("missing"), F.count_if(F.col("_t").isNull()).alias("orphaned"))
    drift = half_up(F.abs(F.col("in_table") - F.col("in_store")) / F.greatest("in_table", F.lit(1)), 4)
    return out.withColumn("drift", drift).withColumn("severity", F.when(F.col("drift") >= 0.25, "high").when(F.col("drift") >= 0.1, "medium").otherwise("low"))
