"""How documents fit a query, which of them answers it at once, and which stands for a line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import once, search_text
from corpusmill.operators.aggregates import half_up

# Weights of what makes a canonical and an active representative.
CANONICAL = {"priority": 0.45, "recency": 0.15, "update": 0.25, "relations": 0.1, "later": 0.05}
ACTIVE = {"priority": 0.35, "recency": 0.25, "update": 0.28, "relations": 0.07, "later": 0.05}


def query_words(query: Column) -> Column:
    """Different words of a query of three letters or more, in the form that searches compare."""
    return F.filter(F.array_distinct(F.split(search_text(query), " ")), lambda w: F.length(w) >= 3)


def held(words: Column, text: Column) -> Column:
    """How many of some words a text in comparison form has."""
    return once(text, lambda whole: F.size(F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.contains(whole, w))))


def alignment(text: Column, query: Column, retrieval: Column, intent: Column, subtopic: Column) -> Column:
    """A struct of ``score`` (0 to 1.2), ``matched``, ``intent_terms``, ``subtopic_terms`` and ``retrieval``: how a text fits a query.

    ``intent`` and ``subtopic`` are structs of ``label``, ``terms`` and ``confidence``, or null. The query's words count 0.42,
    the retrieval score 0.34; labels and terms that the text holds by their confidence. A text with one word of three and
    nothing of the subtopic loses to 0.58, one that misses a sure subtopic and isn't retrieved well to 0.72. An empty text has 0.
    """
    named = lambda about, whole: F.coalesce(F.contains(whole, search_text(about["label"])) & (search_text(about["label"]) != ""), F.lit(False))
    terms = lambda about, whole: held(F.transform(about["terms"], search_text), whole)
    told = lambda whole, words: F.struct(
        (whole == "").alias("empty"), F.size(words).alias("asked"), held(words, whole).alias("matched"), named(intent, whole).alias("intent"), terms(intent, whole).alias("intent_terms"), named(subtopic, whole).alias("subtopic"), terms(subtopic, whole).alias("subtopic_terms")
    )
    # the text and the counts in it are evaluated once a row
    counted = once(F.coalesce(search_text(text), F.lit("")), lambda whole: once(query_words(query), lambda words: told(whole, words)))
    return once(counted, lambda n: _aligned(n, retrieval, intent, subtopic))


def _aligned(n: Column, retrieval: Column, intent: Column, subtopic: Column) -> Column:
    """``alignment`` from what a text holds."""
    matched, asked = n["matched"], n["asked"]
    found = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(retrieval, F.lit(0.0))))
    sure = lambda about: F.coalesce(about["confidence"], F.lit(0.0))
    boost = lambda about, name, label, most, each: (F.when(n[name], label).otherwise(0.0) + F.least(F.lit(most), n[f"{name}_terms"] * each)) * sure(about)
    score = F.when(asked > 0, matched / asked).otherwise(0.0) * 0.42 + found * 0.34 + boost(intent, "intent", 0.16, 0.18, 0.05) + boost(subtopic, "subtopic", 0.28, 0.34, 0.08)
    misses = (n["subtopic_terms"] == 0) & ~n["subtopic"]
    score = score * F.when((asked >= 3) & (matched <= 1) & misses, 0.58).otherwise(1.0)
    score = score * F.when((sure(subtopic) >= 0.72) & misses & (found < 0.8), 0.72).otherwise(1.0)
    value = half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.2), score)), 2)
    zero = lambda x, none: F.when(n["empty"], none).otherwise(x)
    return F.struct(zero(value, 0.0).alias("score"), zero(matched, 0).alias("matched"), zero(n["intent_terms"], 0).alias("intent_terms"), zero(n["subtopic_terms"], 0).alias("subtopic_terms"), zero(found, 0.0).alias("retrieval"))


def direct_choice(hits: DataFrame, by: str, key: str, raw: str, text: Column, query: Column, subtopic: Column) -> DataFrame:
    """The hit of each query that answers it most directly, and whether it does so strongly.

    A hit's value is 1.45 * (score / best) + 2.2 * the share of the query's words in it + 2.8 * its subtopic; ties go to the smaller key.
    It is strong with 0.9 of the best score or more, if the next hit's score is 0.04 less or it holds two words of the query.
    """
    words, whole = query_words(query), F.coalesce(search_text(text), F.lit(""))
    rows = hits.select(by, key, F.col(raw).alias("_raw"), held(words, whole).alias("overlap"), F.size(words).alias("_asked"), F.coalesce(subtopic, F.lit(0.0)).alias("_sub"))
    best = rows.groupBy(by).agg(F.max("_raw").alias("_best"))
    rows = rows.join(best, by).withColumn("norm", F.coalesce(F.col("_raw") / F.nullif(F.col("_best"), F.lit(0.0)), F.lit(0.0)))
    value = F.col("norm") * 1.45 + F.when(F.col("_asked") > 0, F.col("overlap") / F.col("_asked")).otherwise(0.0) * 2.2 + F.col("_sub") * 2.8
    first = rows.withColumn("_v", value).groupBy(by).agg(F.min(F.struct((-F.col("_v")).alias("_v"), key, "_raw", "norm", "overlap")).alias("f")).select(by, "f.*")
    second = rows.join(first.select(by, F.col(key).alias("_first")), by).where(F.col(key) != F.col("_first")).groupBy(by).agg(F.max("_raw").alias("_second"))
    gap = F.col("_raw") - F.coalesce("_second", F.lit(0.0))
    strong = (F.col("norm") >= 0.9) & ((gap >= 0.04) | (F.col("overlap") >= 2))
    return first.join(second, by, "left").select(by, key, half_up(-F.col("_v"), 4).alias("value"), "overlap", strong.alias("strong"))


def visible_representatives(entries: DataFrame, by: str, key: str, lines: DataFrame) -> DataFrame:
    """Which document stands for each line, and why: its canonical one, or a recent one that updates it.

    ``entries`` has ``priority``, ``recency``, ``update``, ``relations``, ``later`` and ``obsolete`` for each document of a line;
    ``lines`` its ``canonical`` document, graph ``status`` and ``spread`` in years. Only lines in review or strained that
    span 3.5 years or more change: to the best of those documents that are recent (0.68), update (0.34) and aren't obsolete
    (under 0.9), if it comes within 0.06 of the canonical one or is strong in all (0.55, 0.78, 0.32 of its priority).
    """
    total = lambda weights: reduce(Column.__add__, [F.col(n) * w for n, w in weights.items()])
    rows = entries.join(lines, by)
    own = rows.where(F.col(key) == F.col("canonical")).select(by, "canonical", "status", "spread", total(CANONICAL).alias("_own"), F.col("priority").alias("_priority"), F.col("obsolete").alias("_obsolete"), F.col("later").alias("_later"), F.col("recency").alias("_recency"))
    changes = F.col("status").isin("in_review", "strained") & (F.col("spread") >= 3.5)
    active = rows.where((F.col(key) != F.col("canonical")) & (F.col("recency") >= 0.68) & (F.col("update") >= 0.34) & (F.col("obsolete") < 0.9)).withColumn("_c", total(ACTIVE))
    active = active.select(by, key, "_c", "priority", "recency", "update").join(own.where(changes).select(by, "_own", "_priority"), by)
    takes = (F.col("_c") >= F.col("_own") - 0.06) | ((F.col("update") >= 0.55) & (F.col("recency") >= 0.78) & (F.col("priority") >= F.col("_priority") - 0.32))
    order = Window.partitionBy(by).orderBy(F.desc("_c"), F.desc("priority"), F.desc("recency"), key)
    chosen = active.where(takes).withColumn("_r", F.row_number().over(order)).where("_r = 1").select(by, F.col(key).alias("_active"))
    reason = F.when(F.col("_active").isNotNull(), "updates").when(F.col("_obsolete") >= 0.5, "least_displaced").when(F.col("_later") >= 0.34, "taken_up_later").when(F.col("_recency") >= 0.55, "recent").otherwise("central")
    return own.join(chosen, by, "left").select(by, F.coalesce("_active", "canonical").alias("representative"), reason.alias("reason"))


# Phrases (in comparison form) that overrule what a model says of a document.
FRAMES = {
    "complement": r"\bse complementa\b|\bcomplementa\b",
    "clarification": r"\baclara\b|\bprecisa\b|\blineamientos\b|\binstrucciones sobre\b",
    "instruction": r"\bimparte instrucciones\b|\blineamientos\b|\bcriterios\b",
    "rule": r"\ben los terminos que se indican\b|\bcon las limitaciones que se indican\b|\bdebe\b|\bcorresponde\b",
    "abstention": r"\bse abstiene\b|\bse abstendra\b|\bno corresponde\b|\bno compete\b|\brestituye sin tramitar\b",
    "exclusive": r"\bcompetencia exclusiva\b|\batribuciones exclusivas\b|\bcorresponde exclusivamente\b|\bservicio electoral\b|\bsuperintendencia de seguridad social\b|\btribunales de justicia\b",
    "litigation": r"\blitigios[ao]\b|\bjuicios?\b|\bcausas judiciales\b|\bsede contenciosa\b",
}


def merged_metadata(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with role, reading_role, validity, intervention and confidence after a model's words and six rules over them.

    Columns read: those five of ``metadata.document_metadata`` with ``currentness``, ``centrality``, ``supports`` and
    ``closes_competence``, and ``model_role``, ``model_reading_role``, ``model_validity``, ``model_intervention`` and
    ``model_confidence``, which count where they aren't null. Where the model says ``application``, the first rule that the
    text fits overrules it (``reason``). A role of limitation becomes what the states make of it; ``review`` follows the confidence.
    """
    c = F.col
    folded = F.coalesce(search_text(text), F.lit(""))
    out = df.withColumns({f"_{name}": folded.rlike(pattern) for name, pattern in FRAMES.items()})
    applied = F.coalesce(c("model_role") == "application", F.lit(False))
    entry = c("_rule") | c("_exclusive") | (c("currentness") >= 0.56)
    kept = lambda other: F.when(c("validity") == "undetermined", other).otherwise(c("validity"))
    none = F.lit(None).cast("string")
    rules = [
        (c("_complement"), "complement", "complement", F.lit("doctrinal_entry"), none, none, 0.06),
        (c("_clarification") & ~c("_complement"), "clarification", "clarification", F.lit("doctrinal_entry"), none, none, 0.05),
        (c("_instruction") & c("_rule") & (c("currentness") >= 0.58) & (c("centrality") >= 0.3), "operational_rule", "current_rule", F.lit("current_state"), kept("in_force"), none, 0.08),
        ((c("intervention") == "abstains") & (c("_abstention") | c("_rule") | c("_exclusive") | (c("reading_role") == "doctrinal_entry")), "abstention", "abstention", F.when(entry, "doctrinal_entry").otherwise("context"), kept(F.when(entry, "in_force").otherwise("in_force_strained")), F.lit("abstains"), 0.07),
        ((c("intervention") == "litigious") & (c("_litigation") | c("_exclusive") | c("_rule")), "litigious", "litigious", F.when(c("_rule") | (c("currentness") >= 0.56), "current_state").otherwise("doctrinal_entry"), kept("in_force_strained"), F.lit("litigious"), 0.08),
        (c("closes_competence") & (c("_exclusive") | c("_rule")), "competence_closure", "competence_closure", F.lit("doctrinal_entry"), kept("in_force_strained"), F.lit("residual"), 0.08),
    ]
    names = ("reason", "role", "reading_role", "validity", "intervention", "delta")
    told = [F.when(applied & F.coalesce(condition, F.lit(False)), F.struct(*[x.alias(n) for x, n in zip((F.lit(reason), F.lit(role), reading, validity, intervention, F.lit(delta)), names)])) for condition, reason, role, reading, validity, intervention, delta in rules]
    out = out.withColumn("_o", F.coalesce(*told))
    out = out.withColumns({n: F.coalesce(c("_o")[n], c(f"model_{n}"), c(n)) for n in ("role", "reading_role", "validity", "intervention")})
    said = half_up(F.coalesce("model_confidence", "confidence"), 3)
    out = out.withColumns({"confidence": half_up(F.least(F.lit(1.0), said + F.coalesce(c("_o.delta"), F.lit(0.0))), 3), "reason": c("_o.reason")})
    turned = (c("reading_role") == "turning_point") | c("validity").isin("displaced", "partly_displaced", "under_review")
    canonical = F.when(c("intervention") == "abstains", "abstention").when(c("intervention") == "litigious", "litigious").when(turned, "adjustment").otherwise("clarification")
    out = out.withColumn("role", F.when(c("role") == "limitation", canonical).otherwise(c("role")))
    return out.withColumn("review", F.when(c("confidence") < 0.58, "needs_review").otherwise("ready")).drop("_o", *[f"_{n}" for n in FRAMES])
