"""Mending what older loads left: stored sources, relations in full texts, lost tags, empty lists, rows to look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import squeeze, tag_display
from corpusmill.operators import joins

# Kinds of sources by their older spellings, and the kinds whose numbers are plain.
KINDS = {
    "ley": "Ley", "dfl": "DFL", "dl": "DL", "dto": "Decreto", "decreto": "Decreto", "ds": "Decreto Supremo", "decreto supremo": "Decreto Supremo", "res": "Resolución", "resolución": "Resolución", "resolucion": "Resolución",
    "resolución exenta": "Resolución Exenta", "resolucion exenta": "Resolución Exenta", "oficio circular": "Oficio Circular", "ctr": "Código del Trabajo", "cci": "Código Civil", "cag": "Código de Aguas", "csa": "Código Sanitario",
    "pol": "Constitución Política de la República", "constitución": "Constitución Política de la República", "constitucion": "Constitución Política de la República", "constitución política": "Constitución Política de la República", "constitucion politica": "Constitución Política de la República", "cpr": "Constitución Política de la República",
}
NUMBERED = ["Ley", "DL", "DFL", "Decreto", "Decreto Supremo", "Resolución", "Resolución Exenta", "Oficio Circular"]
# What verbs say of the document that is named after them.
VERBS = {
    "compleméntase": "complemented", "complementa": "complemented", "aclárase": "clarified", "aclara": "clarified", "reconsidérase": "reconsidered", "reconsidera": "reconsidered", "altera": "altered",
    "alteró": "altered", "confírmase": "confirmed", "confirmó": "confirmed", "reactiva": "reactivated", "reactívase": "reactivated", "aplícase": "applied", "aplica": "applied",
}
# Where an issue of a row is seen.
AREAS = {
    "empty_matter": ["doctrine_lines", "doctrine_clusters", "cluster_label", "dominant_theme", "matter_evaluated"], "narrative_matter": ["doctrine_lines", "doctrine_clusters", "cluster_label", "dominant_theme", "matter_evaluated"],
    "empty_labels": ["doctrine_search", "query_match_reason"], "generic_labels": ["doctrine_search", "query_match_reason"], "label_noise": ["doctrine_search", "query_match_reason"],
    "weak_title": ["key_documents", "demo_titles", "doctrine_search"], "weak_summary": ["key_documents", "demo_titles", "doctrine_search"], "weak_analysis": ["key_documents", "demo_titles", "doctrine_search"],
    "matter_mismatch": ["doctrine_lines", "doctrine_search", "query_match_reason"],
}
SEMANTIC = ["narrative_matter", "generic_labels", "weak_title", "weak_summary", "weak_analysis", "matter_mismatch"]


def _mapped(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def canonical_sources(df: DataFrame, kind: str, number: str, year: str) -> DataFrame:
    """``df`` with kinds of sources in their usual form, numbers without dots where the kind's are plain, and years without ``.0``: one projection."""
    named = F.coalesce(_mapped(KINDS, F.lower(F.trim(kind))), F.col(kind))
    plain = F.when(F.trim(number).rlike("^[0-9.]"), F.replace(F.trim(number), F.lit("."), F.lit(""))).otherwise(F.col(number))
    whole = F.regexp_extract(F.trim(year), r"^([0-9]+)", 1).cast("long").cast("string")
    return df.withColumn(kind, named).withColumns({number: F.when(F.col(kind).isin(NUMBERED), plain).otherwise(F.col(number)), year: F.when(F.trim(year).rlike(r"^[0-9].*\.0$|^[0-9]\.0$"), whole).otherwise(F.col(year))})


def historical_relations(docs: DataFrame, key: str, text: str, number: str, year: str) -> tuple[DataFrame, DataFrame]:
    """(edges, flags): what full texts say of documents that they name by number and year, and which actions each of those has met.

    A verb goes with the next reference on its line ("N° 12.345, de 1999"). A reference means the document of that year with
    the number, or else one that contains it; those that mean none are left out, and equal edges are one.
    """
    pattern = rf"(?iu)({'|'.join(VERBS)}).*?N°?\s*([0-9.]+),?\s+de\s+(\d{{4}})"
    found = docs.select(F.col(key).alias("src"), F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("m"))
    part = lambda i: F.regexp_extract("m", pattern, i)
    refs = found.select("src", _mapped(VERBS, F.lower(part(1))).alias("action"), F.replace(part(2), F.lit("."), F.lit("")).alias("number"), part(3).cast("int").alias("year")).where("number <> ''").distinct()
    edges = joins.resolve_numbers(refs, "number", "year", docs, key, number, year).where("resolved IS NOT NULL").select("src", F.col("resolved").alias("dst"), "action").distinct()
    return edges, edges.groupBy("dst").agg(F.array_sort(F.collect_set("action")).alias("flags"))


def recovered_tags(rows: DataFrame, key: str, json: str, tags: DataFrame, tag: str) -> DataFrame:
    """``tags`` (key, tag) and those tags with digits in the JSON lists of ``rows`` that it lacks, in display form; what is no list gives none."""
    each = rows.select(key, F.explode(F.from_json(json, "array<string>")).alias("_t")).where(F.col("_t").rlike(r"\d"))
    new = each.select(key, tag_display(F.col("_t")).alias(tag)).distinct()
    return tags.select(key, tag).unionByName(new.join(tags.select(key, tag), [key, tag], "left_anti"))


def empty_list(json: Column) -> Column:
    """Whether a column of JSON lists holds nothing: null, no items, or one item without fields."""
    return json.isNull() | json.isin("[]", "[{}]")


def lacks_enrichment(title: Column, summary: Column, analysis: Column, labels: Column) -> Column:
    """Whether one of a document's texts is null or blank, or it has no labels."""
    blank = lambda x: x.isNull() | (F.trim(x) == "")
    return blank(title) | blank(summary) | blank(analysis) | labels.isNull() | (labels == "[]")


def newest_or_live(snapshots: DataFrame, date: str, where: Column, live: DataFrame) -> DataFrame:
    """The newest snapshot's rows that pass a filter, or the live query's where there are none; the live one isn't run otherwise."""
    last = snapshots.agg(F.max(date).alias("_last"))
    kept = snapshots.join(F.broadcast(last), F.col(date) == F.col("_last")).where(where).select([c for c in snapshots.columns if c != date])
    return live.select(kept.columns).withColumn("origin", F.lit("live")) if kept.isEmpty() else kept.withColumn("origin", F.lit("snapshot"))


def inspected(df: DataFrame, matter: str, title: str, summary: str, analysis: str, labels: str, generic: list[str], narrative: Column, weak: dict[str, Column], mismatch: Column) -> DataFrame:
    """``df`` with ``issues``, ``areas`` (where they are seen) and ``bucket`` of each row; rows without issues have no bucket.

    Labels are noisy if one has an underscore, two are one when normalised, or one is spelled in two ways. ``weak`` has a
    condition for each of weak_title, weak_summary and weak_analysis.
    """
    text = lambda c: squeeze(F.coalesce(F.col(c), F.lit("")))
    list_ = F.coalesce(F.col(labels), F.array().cast("array<string>"))
    normal = F.filter(F.transform(list_, lambda x: squeeze(F.lower(F.replace(x, F.lit("_"), F.lit(" "))))), lambda x: x != "")
    many = lambda a: F.size(F.array_distinct(a))
    noise = F.exists(list_, lambda x: F.contains(x, F.lit("_"))) | (F.size(normal) > many(normal)) | ((F.size(normal) > 0) & (many(F.transform(list_, squeeze)) > many(normal)))
    empty = text(matter) == ""
    no_labels = F.size(list_) == 0
    is_generic = F.exists(list_, lambda x: squeeze(F.lower(x)).isin(generic))
    holds = {
        "empty_matter": empty, "narrative_matter": ~empty & narrative, "empty_labels": no_labels, "generic_labels": ~no_labels & is_generic, "label_noise": noise, **weak,
        "matter_mismatch": ~empty & ~narrative & F.exists(list_, lambda x: ~squeeze(F.lower(x)).isin(generic)) & mismatch,
    }
    issues = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in holds.items()]))
    out = df.withColumn("issues", issues)
    seen = F.create_map(*[x for name, areas in AREAS.items() for x in (F.lit(name), F.array(*map(F.lit, areas)))])
    areas = F.array_sort(F.array_distinct(F.flatten(F.transform("issues", lambda i: F.element_at(seen, i)))))
    blocked = empty | no_labels | (text(title) == "") | (text(summary) == "") | (text(analysis) == "")
    bucket = F.when(blocked, "blocking").when(F.arrays_overlap("issues", F.array(*map(F.lit, SEMANTIC))), "semantic_review").when(F.array_contains("issues", "label_noise"), "auto_normalizable").when(F.size("issues") > 0, "low_priority")
    return out.withColumn("areas", areas).withColumn("bucket", bucket)
