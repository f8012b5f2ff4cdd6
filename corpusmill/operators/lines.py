"""Doctrine lines as a search shows them: anchors, hybrid scores, order of families, constraint by a query, state of a matter.

The weights and thresholds are fixed values. Hits have ``norm`` (score by the best one, 0 to 1), ``raw`` and ``rank`` (from 1).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import once, search_text, tokens
from corpusmill.operators.aggregates import half_up
from corpusmill.operators.joins import best_per_key
from corpusmill.sources.tables import checkpointed

# What a text says about the state of a matter (score, phrases), and needles that bring such texts first.
STATUS = {
    "abstention": (1.5, ["se abstenga de resolver", "no intervendra ni informara", "no intervendra", "no informara", "corresponde abstenerse", "se abstendra de resolver", "no corresponde emitir pronunciamiento"]),
    "litigious": (1.45, ["materia devino en litigiosa", "ha devenido en litigiosa", "asunto de naturaleza litigiosa", "caracter litigioso", "controversia cuya resolucion compete a los tribunales", "tribunales de justicia"]),
    "change_of_regime": (1.05, ["criterio unificador", "giro jurisprudencial", "cambio de criterio", "en lo sucesivo", "nuevo criterio", "de ahora en adelante"]),
}
NEEDLES = ["litigios", "absten", "tribunal", "pronunciam", "en lo sucesivo"]


def _worth(condition: Column, weight: float) -> Column:
    return F.when(condition, weight).otherwise(0.0)


def line_scores(lines: DataFrame, members: DataFrame, hits: DataFrame, line: str, key: str) -> DataFrame:
    """``lines`` with ``hybrid``: how well each fits a search, by its best, its representative's and its three best hits.

    ``lines``: status, active, importance, risk, priority, intent, subtopic, and currentness, reading_weight and centrality of
    the representative. ``members`` (line, key, representative) may repeat a document; it counts once. A line without a hit
    gets a fifth of its importance. Only the three best hits of a line are summed, chosen before the shuffle.
    """
    met = members.groupBy(line, key).agg(F.max("representative").alias("representative")).join(hits.select(key, "norm", "rank"), key)
    w = Window.partitionBy(line).orderBy(F.desc("norm"), "rank")
    best = met.withColumn("_r", F.row_number().over(w)).where("_r <= 3").groupBy(line).agg(F.max("norm").alias("_peak"), F.sum(F.col("norm").cast("decimal(20,8)")).cast("double").alias("_three"))
    rest = met.groupBy(line).agg(F.max(F.when(F.col("representative"), F.col("norm"))).alias("_own"), (F.min("rank") == 1).alias("_first"))
    c = F.col
    current = _worth(c("status") == "in_review", 0.2) + _worth(c("status") == "strained", 0.12) + c("active") * 0.4 + c("currentness") * 0.45
    value = c("_peak") * 4.2 + F.coalesce("_own", F.lit(0.0)) * 1.6 + c("_three") * 1.25 + _worth(c("_first"), 2.4) + c("intent") + c("subtopic") + c("priority") * 0.55 + c("importance") * 0.25 + current + c("risk") * 0.3 + c("reading_weight") * 0.7 + c("centrality") * 0.55
    out = lines.join(best.join(rest, line), line, "left")
    return out.withColumn("hybrid", half_up(F.when(c("_peak").isNull(), c("importance") * 0.2).otherwise(value), 4)).drop("_peak", "_three", "_own", "_first")


def anchors(lines: DataFrame, members: DataFrame, hits: DataFrame, line: str, key: str) -> DataFrame:
    """The hit of each line that lies nearest to the query, and whether it takes the representative's place.

    ``lines``: active, risk. ``members``: line, key, representative, pivot, recency, subtopic, reading_weight, currentness,
    current_state; a row for each document of a line. Ties go to the higher raw score, the better rank, the smaller key.
    """
    c = F.col
    met = members.join(hits.select(key, "norm", "raw", "rank"), key, "left").join(lines.select(line, "active", "risk"), line)
    pull = c("active") * 0.45 + c("risk") * 0.2
    value = c("norm") * 1.15 + c("recency") * pull + _worth(c("pivot"), 0.12) + c("subtopic") * 0.45 + c("reading_weight") * 0.55 + c("currentness") * 0.35 + _worth(c("current_state"), 0.18)
    best = best_per_key(met.where("norm IS NOT NULL").withColumn("fit", half_up(value, 6)), [line], [F.desc("fit"), F.desc("raw"), c("rank"), c(key)])
    own = met.where("representative").groupBy(line).agg(F.min(key).alias("_key"), F.coalesce(F.max("norm"), F.lit(0.0)).alias("_norm"), F.max("recency").alias("_recency"))
    both = best.join(own, line, "left").withColumn("_ahead", c("norm") - F.coalesce("_norm", F.lit(0.0)))
    fresher = (c("active") >= 0.55) & (c("recency") - F.coalesce("_recency", F.lit(0.0)) >= 0.22) & (c("_ahead") >= -0.04)
    promoted = ~c(key).eqNullSafe(c("_key")) & ((c("norm") >= 0.9) | (c("_ahead") >= 0.18) | fresher)
    shown = F.when(promoted, c(key)).otherwise(F.coalesce("_key", key))
    return both.select(line, c(key).alias("anchor"), "fit", c("recency").alias("anchor_recency"), promoted.alias("promoted"), shown.alias("representative"))


def ranked_lines(lines: DataFrame, line: str, family: str) -> DataFrame:
    """Lines with the score that orders them: hybrid, momentum, and what their family's leader makes of them.

    Columns read: hybrid, status, active, anchor_recency, currentness, reading_weight. A family has a leader if its most
    current line reaches 1.8: lines near it gain, historical ones lose most. No historical line (active under 0.25, recency
    under 0.45) stands before one under active review: its ``order_score`` is at most the least of theirs.
    """
    c = F.col
    review, strained = c("status") == "in_review", c("status") == "strained"
    momentum = _worth(review, 0.35) + _worth(strained, 0.18) + c("active") * 0.45 + c("anchor_recency") * 0.35 - _worth((c("active") < 0.2) & (c("anchor_recency") < 0.35), 0.45)
    current = _worth(review, 0.9) + _worth(strained, 0.5) + c("active") * 1.35 + c("anchor_recency") * 1.1 + c("currentness") * 1.15 + c("reading_weight") * 0.7
    out = lines.withColumns({"presentation": half_up(c("hybrid") + momentum, 4), "current": half_up(current, 4)})
    leaders = out.groupBy(family).agg(F.max("current").alias("_lead"))
    out = out.join(leaders, family).withColumn("historical", (c("active") < 0.25) & (c("anchor_recency") < 0.45))
    adjust = F.when(c("_lead") < 1.8, 0.0).when(c("current") >= c("_lead") - 0.18, 0.55).when(c("historical"), -0.95).otherwise(-0.25)
    out = out.withColumns({"ranked": half_up(c("presentation") + adjust, 4), "_active": (c("active") >= 0.5) & (c("anchor_recency") >= 0.6) & (review | strained)})
    # one row
    least = out.agg(F.min(F.when(c("_active"), c("ranked"))).alias("_least"))
    capped = F.when(c("historical"), F.least("ranked", "_least")).otherwise(c("ranked"))
    return out.crossJoin(F.broadcast(least)).select(line, family, "hybrid", "presentation", "ranked", "historical", capped.alias("order_score"))


def constrained_lines(lines: DataFrame, line: str, title: str, tags: str, segments: str, words: list[str], subtopic: list[str], sure: bool) -> DataFrame:
    """Lines that keep to a query's words and its subtopic's (folded, without general ones), with their score.

    1.55 for the share of the query's words, 1.25 for the subtopic's, 0.32 for a segment with two words of the query and 0.28
    of either (two segments count), 0.30 for words in the title, 0.22 in tags (two count), 0.18 for each word (three count).
    Gates hold words together; where no line passes, a weaker one applies (``strict`` tells). ``sure``: the subtopic is certain.
    Texts are read once; the lines that pass a gate are written before it is known whether any passes the strict one.
    """
    c = F.col
    listed = lambda xs: F.array(*map(F.lit, dict.fromkeys(xs))).cast("array<string>")
    many = lambda xs: max(len(dict.fromkeys(xs)), 1)
    held = lambda found: F.struct(found[0].alias("q"), found[1].alias("s"), F.array_union(*found).alias("a"))
    named = once(tokens(F.array_join(c(segments), " "), 1), lambda t: held([F.array_intersect(listed(xs), t) for xs in (words, subtopic)]))
    holding = lambda parts, xs: F.size(F.filter(parts, lambda p: F.size(F.filter(listed(xs), lambda w: F.contains(p, w))) >= 2))
    general = lambda parts: F.lit(False) if sure else F.array_join(parts, " ").rlike(r"\b(decreto|presidencia|presidenciales|acto|actos)\b")
    tag_words = F.array_distinct(F.flatten(F.transform(c(tags), lambda t: tokens(t, 1))))
    counted = lambda n, parts: F.struct(
        F.size(n["q"]).alias("in_query"), F.size(n["s"]).alias("in_subtopic"), F.size(n["a"]).alias("anchors"), holding(parts, words).alias("segments"), holding(parts, [*words, *subtopic]).alias("cohesive"),
        F.size(F.array_intersect(tokens(c(title), 1), n["a"])).alias("in_title"), F.size(F.array_intersect(tag_words, n["a"])).alias("in_tags"), general(parts).alias("general"),
    )
    few = lambda x, most: F.least(F.lit(most), x)

    def judged(n: Column) -> Column:
        score = n["in_query"] / many(words) * 1.55 + n["in_subtopic"] / many(subtopic) * 1.25 + few(n["segments"], 2) * 0.32 + few(n["cohesive"], 2) * 0.28 + few(n["in_title"], 2) * 0.3 + few(n["in_tags"], 2) * 0.22 + few(n["anchors"], 3) * 0.18
        return once(half_up(score, 3), lambda score: gated(n, score))

    def gated(n: Column, score: Column) -> Column:
        if sure:
            together = (n["in_query"] >= 2) | (n["in_subtopic"] >= 2) | ((n["in_query"] >= 1) & (n["in_subtopic"] >= 1)) | (score >= 1.15)
            strict = (n["anchors"] >= 2) & (n["cohesive"] >= 1) & together
        else:
            strict = ((n["in_query"] >= 2) & (n["segments"] >= 1)) | ((n["anchors"] >= 2) & (n["cohesive"] >= 1) & ~((n["in_query"] == 0) & n["general"])) | (score >= 1.05)
        weak = (score >= (0.95 if sure else 0.8)) & (n["anchors"] >= 1) & (n["cohesive"] >= 1)
        return F.struct(score.alias("score"), n["anchors"].alias("anchors"), n["in_query"].alias("in_query"), n["in_subtopic"].alias("in_subtopic"), F.coalesce(strict, F.lit(False)).alias("strict"), F.coalesce(weak, F.lit(False)).alias("_weak"))

    each = once(once(named, lambda n: once(F.transform(c(segments), search_text), lambda parts: counted(n, parts))), judged)
    # a filter on columns would be pushed below them and evaluate all of it again
    out = checkpointed(lines.select(line, F.explode(F.filter(F.array(each), lambda x: x["strict"] | x["_weak"])).alias("x")).select(line, "x.*"))
    # one row
    any_strict = out.agg(F.coalesce(F.max("strict"), F.lit(False)).alias("_any"))
    return out.crossJoin(F.broadcast(any_strict)).where(c("strict") | ~c("_any")).select(line, "score", "anchors", "in_query", "in_subtopic", "strict")


def matter_status(docs: DataFrame, key: str, texts: list[str], ts: str, metadata: DataFrame, words: list[str], phrases: list[str], as_of: Column, focus=None) -> DataFrame:
    """The document that tells the present state of a query's matter: one row, or none.

    Three stages: documents with one of the first five words, those that speak of states first, then newest (200); of these
    the first 40 with 0.45 of the words or more; then scores of text, age and ``metadata`` (key, bulletin, reactivated,
    applied, complemented, confirmed, currentness, reading_weight, centrality, supports, abstains, litigious,
    closes_competence, confidence). The best must reach 2.45. The limits are the search's own; each stage is a distributed
    top-k.
    """
    c, words = F.col, list(dict.fromkeys(words))
    if not words:
        return docs.sparkSession.createDataFrame([], f"{key} {docs.schema[key].dataType.simpleString()}, score double, category string, confidence double")
    low = [F.lower(F.coalesce(x, F.lit(""))) for x in texts]
    holds = lambda w: reduce(Column.__or__, [F.contains(x, F.lit(w)) for x in low])
    told = reduce(Column.__add__, [holds(n).cast("int") for n in NEEDLES])
    recalled = docs.where(reduce(Column.__or__, [holds(w) for w in words[:5]])).withColumn("_told", told).orderBy(F.desc("_told"), F.desc_nulls_last(ts), key).limit(200)
    listed = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    found = lambda xs, text: F.filter(listed(xs), lambda x: F.contains(text, x))
    parts = F.array(*[F.coalesce(search_text(x), F.lit("")) for x in map(F.col, texts)])
    read = recalled.withColumn("_parts", parts).withColumn("_text", F.array_join("_parts", " ")).withColumn("_found", F.size(found(words, c("_text")))).withColumn("coverage", c("_found") / len(words))
    near = read.where("coverage >= 0.45").orderBy(F.desc("_told"), F.desc_nulls_last(ts), key).limit(40)
    signals = [F.struct((F.size(found(ps, c("_text"))) * value).alias("w"), F.lit(-i).alias("i"), F.size(found(ps, c("_text"))).alias("n"), F.lit(value).alias("value"), F.lit(name).alias("name")) for i, (name, (value, ps)) in enumerate(STATUS.items())]
    best = F.greatest(*signals)
    out = near.withColumn("_s", F.when(best["n"] > 0, best)).join(metadata, key, "left")
    whole = F.size(F.filter("_parts", lambda p: F.size(found(words, p)) >= 2))
    age = F.coalesce(F.greatest(F.lit(0.0), F.datediff(as_of, ts) / 365.25), F.lit(8.0))
    number = lambda x: F.coalesce(c(x).cast("double"), F.lit(0.0))
    value = (
        c("coverage") * 1.75 + F.least(F.lit(2), F.size(found(phrases, c("_text")))) * 0.8 + F.least(F.lit(2), whole) * 0.55 + F.coalesce(c("_s.value") + (c("_s.n") - 1) * 0.25, F.lit(0.0))
        + F.greatest(F.lit(0.0), 1.2 - F.least(F.lit(1.2), age * 0.18)) + _worth(c("bulletin"), 0.18) + _worth(c("reactivated"), 0.14) + _worth(c("applied"), 0.08) + _worth(c("complemented"), 0.05) + _worth(c("confirmed"), 0.06)
        + number("currentness") * 1.4 + number("reading_weight") * 0.95 + number("centrality") * 0.45 + _worth(c("supports"), 0.24) - _worth(c("abstains") & c("_s").isNull(), 0.2) - _worth(c(key) == F.lit(focus), 0.2)
    )
    kept = (c("_found") >= min(2, len(words))) & ((F.size(found(phrases, c("_text"))) >= 1) | (whole >= 1)) & (c("_s").isNotNull() | (number("currentness") >= 0.62) | F.coalesce("supports", F.lit(False)))
    category = F.coalesce(c("_s.name"), F.when(c("abstains"), "abstention"), F.when(c("litigious"), "litigious"), F.when(c("closes_competence"), "change_of_regime"), F.lit("current_rule"))
    first = out.where(kept).withColumn("score", half_up(value, 3)).orderBy(F.desc("score"), F.desc_nulls_last(ts), key).limit(1)
    confidence = half_up((c("score") + number("confidence")) / 5.1, 2)
    return first.where("score >= 2.45").select(key, "score", category.alias("category"), F.greatest(F.lit(0.55), F.least(F.lit(0.98), confidence)).alias("confidence"))
