"""Quality of tables: inspection, findings, checks, catalogs, incidents, repeated events."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A span of time, in multiples of the time in which an event repeats another.
SPAN = 256


def inspect(df: DataFrame, issues: dict[str, Column], severe: list[str]) -> DataFrame:
    """Rows with the names of the issues that they have, and a bucket: ok, minor, major (a severe one) or critical (two)."""
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in issues.items()]), lambda x: x.isNotNull())
    out = df.withColumn("issues", found)
    n = F.size(F.array_intersect("issues", F.array(*[F.lit(s) for s in severe])))
    return out.withColumn("bucket", F.when(F.size("issues") == 0, "ok").when(n == 0, "minor").when(n == 1, "major").otherwise("critical"))


def issue_summary(inspected: DataFrame, population: int) -> DataFrame:
    """Rows for each issue with its share, an estimate for the population and how bad that is."""
    total = inspected.agg(F.count("*").alias("_all"))
    counts = inspected.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))
    out = counts.crossJoin(F.broadcast(total)).withColumn("share", F.floor(F.col("n") / F.col("_all") * 10000.0 + 0.5) / 10000.0)
    return out.select("issue", "n", "share", F.floor(F.col("n") / F.col("_all") * population + 0.5).cast("long").alias("estimate"), F.when(F.col("share") >= 0.25, "high").when(F.col("share") >= 0.1, "medium").otherwise("low").alias("severity"))


def checks(tests: dict[str, DataFrame]) -> DataFrame:
    """One row for each check with the number of rows that fail it."""
    return reduce(DataFrame.unionByName, [bad.agg(F.count("*").alias("failing")).select(F.lit(name).alias("check_name"), "failing") for name, bad in tests.items()])


def catalog_backfill(mentions: DataFrame, doc: str, raw: str, norm: Column, rejects: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(catalog, report): different accepted forms with their mentions and documents; and rows by what became of them."""
    verdict = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rejects.items()], F.lit("accepted"))
    marked = mentions.withColumn("norm", norm).withColumn("verdict", verdict)
    # what repeats is counted before it moves
    by_doc = marked.where("verdict = 'accepted'").groupBy("norm", doc).agg(F.count("*").alias("_n"), F.min(raw).alias("_raw"))
    catalog = by_doc.groupBy("norm").agg(F.sum("_n").alias("mentions"), F.count(doc).alias("documents"), F.min("_raw").alias("display"))
    forms = marked.groupBy("verdict", "norm").agg(F.count("*").alias("_n"))
    return catalog, forms.groupBy("verdict").agg(F.sum("_n").alias("n"), F.count("norm").alias("different"))


def guard(report: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Whether a batch may be written: the share of each verdict against its limit."""
    total = report.agg(F.sum("n").alias("_all"))
    limit = F.coalesce(*[F.when(F.col("verdict") == v, F.lit(x)) for v, x in limits.items()], F.lit(1.0))
    out = report.crossJoin(F.broadcast(total)).withColumn("share", F.floor(F.col("n") / F.col("_all") * 10000.0 + 0.5) / 10000.0)
    return out.select("verdict", "n", "share", (F.col("share") <= limit).alias("allowed"))


def validator_score(penalties: dict[str, tuple[Column, int]]) -> Column:
    """100 less the penalties that apply, at least 0."""
    return F.greatest(F.lit(0), reduce(Column.__sub__, [F.when(F.coalesce(c, F.lit(False)), p).otherwise(0) for c, p in penalties.values()], F.lit(100)))


def incidents(df: DataFrame, message: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rows with system and code of the first rule (pattern, system, code) that their message matches, and the part that it names."""
    m = F.col(message)
    found = F.coalesce(*[F.when(m.rlike(p), F.struct(F.lit(s).alias("system"), F.lit(c).alias("code"), (F.nullif(F.regexp_extract(m, p, 1), F.lit("")) if "(" in p else F.lit(None).cast("string")).alias("named"))) for p, s, c in rules], F.struct(F.lit("unknown").alias("system"), F.lit("UNKNOWN").alias("code"), F.lit(None).cast("string").alias("named")))
    return df.withColumn("_i", found).select(*df.columns, "_i.system", "_i.code", "_i.named")


def routed(df: DataFrame, value: str, rules: DataFrame) -> DataFrame:
    """Rows with the handler of the first rule (ordinal, pattern, handler) whose pattern their value matches; rules are few and fixed."""
    values = df.select(value).distinct()
    hit = values.join(rules, F.regexp_like(F.col(value), F.col("pattern"))).groupBy(value).agg(F.min_by("handler", "ordinal").alias("handler"))
    return df.join(hit, value, "left")


def without_repeats(events: DataFrame, keys: list[str], ts: str, order: str, seconds: int) -> DataFrame:
    """Events of a key that come at least some seconds after the last one kept.

    An event that comes so long after the one before it is kept whatever was kept before, so a key's events fall into
    bursts that don't depend on each other; only inside a burst they are walked in order. Bursts are told apart inside
    spans of time, and from the ends of spans, so no task sorts all events of a key.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = events.select(*keys, ts, order).withColumn("_t", micros).withColumn("_span", F.floor(micros / (seconds * 1_000_000 * SPAN)))
    inside, across = Window.partitionBy(*keys, "_span"), Window.partitionBy(*keys).orderBy("_span")
    first = rows.withColumn("_before", F.lag("_t").over(inside.orderBy(ts, order)))
    far = lambda before: F.coalesce(F.col("_t") - before >= seconds * 1_000_000, F.lit(True)).cast("int")
    spans = first.groupBy(*keys, "_span").agg(F.min("_t").alias("_t"), F.max("_t").alias("_last"), F.sum(F.when(F.col("_before").isNotNull(), far(F.col("_before"))).otherwise(0)).alias("_inner"))
    spans = spans.withColumn("_starts", far(F.lag("_last").over(across)))
    spans = spans.withColumn("_base", F.sum(F.col("_inner") + F.col("_starts")).over(across) - F.col("_inner")).select(*keys, "_span", "_base")
    later = F.sum(F.when(F.col("_before").isNotNull(), far(F.col("_before"))).otherwise(0)).over(inside.orderBy(ts, order))
    a, b = first.withColumn("_later", later).alias("a"), spans.alias("b")
    same = reduce(Column.__and__, [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in (*keys, "_span")])
    rows = a.join(b, same).select(*[F.col(f"a.`{c}`") for c in (*keys, ts, order)], (F.col("_base") + F.col("_later")).alias("_burst"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([ts, order])
        keep, last = [], None
        for t in pdf[ts]:
            take = last is None or (t - last).total_seconds() >= seconds
            keep.append(take)
            last = t if take else last
        return pdf.loc[keep, [*keys, ts, order]]

    # a burst of one row needs no walk
    alone = F.count("*").over(Window.partitionBy(*keys, "_burst")) == 1
    marked = rows.withColumn("_alone", alone)
    walked = marked.where("NOT _alone").groupBy(*keys, "_burst").applyInPandas(walk, events.select(*keys, ts, order).schema)
    return marked.where("_alone").select(*keys, ts, order).unionByName(walked)


def recovered_tags(df: DataFrame, key: str, json: str) -> DataFrame:
    """Different tags with digits inside JSON arrays, normalised."""
    tag = F.explode(F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>")))
    return df.select(key, tag.alias("tag")).where(F.col("tag").rlike(r"\d")).select(key, F.lower(F.trim("tag")).alias("tag")).distinct()
