"""Corpus statistics: grouped counts, conditional counts, modes, top lists, weighted means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.sources.tables import dealt


def exact_sum(x: Column, scale: int = 4) -> Column:
    """A sum of doubles that doesn't depend on the order of rows."""
    return F.sum(x.cast(f"decimal(18,{scale})")).cast("double")


def mention_heatmap(mentions: DataFrame, doc: str, source: str, ts: str, labels: DataFrame, label_cols: list[str], limit: int, parts: int | None = None) -> DataFrame:
    """Mentions and documents per year and source label, most mentioned first.

    First one row for each (year, document, source), so that the second grouping counts documents without a distinct.
    Ties end in the labels. ``parts``: into how many partitions rows are dealt; mentions that are dealt by document stay so.
    """
    per_doc = mentions.groupBy(F.year(ts).alias("year"), doc, source).agg(F.count("*").alias("n"), F.max(ts).alias("last"))
    out = dealt(per_doc, parts, source).join(labels, source).groupBy("year", *label_cols).agg(F.sum("n").alias("mentions"), F.count("*").alias("documents"), F.max("last").alias("last_date"))
    return out.orderBy(F.desc("mentions"), F.desc("documents"), "year", *label_cols).limit(limit)


def conditional_counts(df: DataFrame, by: list[str], conditions: dict[str, Column], total: str | None = "total") -> DataFrame:
    """One pass over ``df``: rows of each group, and of them those for which each condition holds (null: not)."""
    counts = [F.count("*").alias(total)] if total else []
    return df.groupBy(*by).agg(*counts, *[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in conditions.items()])


def most_frequent(df: DataFrame, by: list[str], label: str, n: int = 1) -> DataFrame:
    """The ``n`` most frequent labels of each group with their counts and ranks; ties go to the smaller label."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("n"))
    if not by:
        rank = F.row_number().over(Window.orderBy(F.desc("n"), label))
        return counts.orderBy(F.desc("n"), label).limit(n).withColumn("rank", rank)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), label))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def fan_out_counts(base: DataFrame, key: str, sides: dict[str, DataFrame]) -> DataFrame:
    """For each row of ``base`` how many different values each side has for its key; each side is counted before it is joined."""
    out = base
    for name, side in sides.items():
        value = next(c for c in side.columns if c != key)
        out = out.join(side.groupBy(key).agg(F.count_distinct(value).alias(name)), key, "left")
    return out.fillna(0, subset=list(sides))


def weighted_mean(df: DataFrame, by: list[str], value: str, weight: str, digits: int = 2) -> DataFrame:
    """Mean of value by weight, rounded half up; null where the weights add to nothing."""
    mean = exact_sum(F.col(value) * F.col(weight)) / F.nullif(exact_sum(F.col(weight)), F.lit(0.0))
    return df.groupBy(*by).agg(half_up(mean, digits).alias("weighted_mean"), F.count("*").alias("n"))


def half_up(x: Column, digits: int = 2) -> Column:
    """floor(x * 10^digits + 0.5) / 10^digits, which is how scores are rounded here."""
    return F.floor(x * float(10**digits) + 0.5) / float(10**digits)


def highest_by_rank(df: DataFrame, by: list[str], label: str, order: list[str]) -> DataFrame:
    """The label of each group that stands last in ``order``; labels that aren't in it count below all."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(label)), F.lit(0))
    return df.groupBy(*by).agg(F.max_by(label, F.struct(rank, F.col(label))).alias("highest"))


def population_estimate(sample: DataFrame, condition: Column, population: int) -> DataFrame:
    """Count of a sample's rows, share for which the condition holds, and what that makes of the population."""
    counted = sample.agg(F.count("*").alias("sampled"), F.count_if(condition).alias("matching"))
    return counted.withColumn("estimate", F.floor(F.col("matching") / F.greatest("sampled", F.lit(1)) * population + 0.5).cast("long"))


def labels_by_group(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """A JSON array of each key's different values, in order."""
    return df.groupBy(key).agg(F.to_json(F.array_sort(F.collect_set(value))).alias(out))


def examples(df: DataFrame, by: list[str], value: str, n: int = 5) -> DataFrame:
    """Rows of each group and its first ``n`` different values in order; no group is gathered beyond that."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(value))
    different = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    counts = different.groupBy(*by).agg(F.sum("_n").alias("n"))
    first = different.withColumn("_r", rank).where(F.col("_r") <= n).groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("examples"))
    return counts.join(first, by)


def shared_sources(mentions: DataFrame, doc: str, source: str, canonical: str, least: int = 2) -> DataFrame:
    """Canonical sources that ``least`` or more documents cite, with the different spellings; spellings are joined before they are counted."""
    return mentions.groupBy(canonical).agg(F.count_distinct(doc).alias("documents"), F.array_join(F.array_sort(F.collect_set(F.col(source).cast("string"))), ",").alias("spellings")).where(F.col("documents") >= least)
