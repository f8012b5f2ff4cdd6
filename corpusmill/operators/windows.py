"""Order-dependent operators: top rows, spans, scaling inside groups, decayed ranks, active slices, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.aggregates import half_up


def span(df: DataFrame, by: list[str], key: str, ts: str) -> DataFrame:
    """Oldest and newest row of a group, by time then key, and the years between."""
    order = F.struct(F.col(ts), F.col(key))
    out = df.groupBy(*by).agg(F.min_by(key, order).alias("oldest"), F.max_by(key, order).alias("newest"), F.min(ts).alias("from_ts"), F.max(ts).alias("to_ts"))
    return out.withColumn("years", half_up(F.datediff("to_ts", "from_ts") / 365.25))


def scaled(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The value on 0..1 between its group's extremes (0.5 where they agree) and its nearness to the group's upper median."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    rank, n = F.row_number().over(w.orderBy(value)), F.count("*").over(w)
    marked = df.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_r", rank).withColumn("_n", n)
    middle = F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2) + 1, F.col(value))).over(w)
    width = F.col("_hi") - F.col("_lo")
    out = marked.withColumn("_mid", middle).withColumn("scaled", F.when(width > 0, half_up((F.col(value) - F.col("_lo")) / width, 3)).otherwise(0.5))
    return out.withColumn("centrality", F.when(width > 0, half_up(1 - F.abs(F.col(value) - F.col("_mid")) / width, 3)).otherwise(1.0)).drop("_lo", "_hi", "_r", "_n", "_mid")


def decayed_rank_scores(ranked: DataFrame, query: str, label: str, score: str, key: str) -> DataFrame:
    """Sum of rank weights of each label over a query's hits: 1.6 for the first, then max(0.45, 1.15 - 0.08 * rank)."""
    w = Window.partitionBy(query).orderBy(F.desc(score), key)
    index = F.row_number().over(w) - 1
    weight = F.when(F.col("_i") == 0, 1.6).otherwise(F.greatest(F.lit(0.45), 1.15 - F.col("_i") * 0.08))
    total = F.sum(weight.cast("decimal(18,4)")).cast("double")
    return ranked.withColumn("_i", index).groupBy(query, label).agg(half_up(total).alias("score"), F.count("*").alias("hits"))


def normalised(df: DataFrame, by: list[str], score: str, key: str) -> DataFrame:
    """Score by the group's greatest, and rank from 0."""
    w = Window.partitionBy(*by)
    return df.withColumn("normalised", half_up(F.col(score) / F.nullif(F.max(score).over(w), F.lit(0.0)), 4)).withColumn("rank_index", F.row_number().over(w.orderBy(F.desc(score), key)) - 1)


def family_relative(df: DataFrame, family: str, score: str, key: str) -> DataFrame:
    """Each row's distance from the leader of its family, and whether it leads."""
    w = Window.partitionBy(family)
    return df.withColumn("gap", half_up(F.max(score).over(w) - F.col(score), 2)).withColumn("leads", F.row_number().over(w.orderBy(F.desc(score), key)) == 1)


def active_slice(df: DataFrame, by: list[str], ts: str, years: int, keep: Column) -> DataFrame:
    """Rows not older than some years before the newest of their group, or for which ``keep`` holds."""
    last = F.max(ts).over(Window.partitionBy(*by))
    return df.withColumn("_last", last).where((F.col(ts) >= F.add_months("_last", -12 * years).cast("timestamp")) | keep).drop("_last")


def transitions(events: DataFrame, key: str, ts: str, order: str, state: str) -> DataFrame:
    """Events in order with the state before each, and whether it changed."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(ts, order))
    return events.withColumn("state_before", before).withColumn("changed", ~F.col("state_before").eqNullSafe(F.col(state)))


def bigrams(text: Column) -> Column:
    """Pairs of neighbouring tokens of a text, joined by a blank."""
    words = F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda x: x != "")
    n = F.size(words)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(1))), F.slice(words, 2, F.greatest(n - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)))
