"""Rule-based scores of documents and clusters. The coefficients of the scores are fixed values."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.aggregates import half_up


def _clamped(x: Column) -> Column:
    return half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 3)


def document_scores(df: DataFrame) -> DataFrame:
    """Currentness, historical weight, centrality, shift and drift of documents, and a family score of these.

    Columns read: in_total, out_total, in_strengthens, in_develops, in_limits, in_displaces, in_adjusts, out_displaces
    (counts), recency (0..1) and the flags relevant, bulletin, reactivated, clarified, abstained, topic, sources (0 or 1).
    """
    c = F.col
    against = c("in_displaces") + c("in_limits") + c("in_adjusts")
    degree = F.least(F.lit(1.0), (c("in_total") + c("out_total")) / 8)
    some = lambda x: F.when(x > 0, 1.0).otherwise(0.0)
    currentness = c("recency") * 0.36 + c("relevant") * 0.16 + some(c("in_strengthens")) * 0.15 + c("reactivated") * 0.12 + some(c("in_develops")) * 0.04 - F.least(F.lit(0.26), against * 0.09) - c("abstained") * 0.04
    historical = degree * 0.22 + c("relevant") * 0.16 + c("bulletin") * 0.10 + F.least(F.lit(0.28), c("in_total") * 0.07) + F.least(F.lit(0.14), c("in_displaces") * 0.14) + F.least(F.lit(0.10), c("in_limits") * 0.08) + (1 - c("recency")) * 0.12
    centrality = degree * 0.25 + c("relevant") * 0.18 + c("bulletin") * 0.09 + c("sources") * 0.08 + F.least(F.lit(0.18), c("in_total") * 0.05) + F.least(F.lit(0.14), c("out_total") * 0.04)
    shift = F.least(F.lit(0.34), c("out_displaces") * 0.12) + c("reactivated") * 0.12 + F.least(F.lit(0.08), c("in_displaces") * 0.08)
    drift = (1 - c("topic")) * 0.2 + (1 - c("sources")) * 0.12 + F.when((c("relevant") == 0) & (c("bulletin") == 0), 0.08).otherwise(0.0) + c("abstained") * 0.1 + F.greatest(F.lit(0.0), 0.18 - degree * 0.18)
    out = df.withColumns({"currentness": _clamped(currentness), "historical": _clamped(historical), "centrality": _clamped(centrality), "shift": _clamped(shift), "drift": _clamped(drift)})
    family = c("centrality") * 0.48 + c("currentness") * 0.22 + c("historical") * 0.18 + (1 - c("drift")) * 0.12
    out = out.withColumn("family", _clamped(family)).withColumn("supports", (c("currentness") >= 0.58) & (c("abstained") == 0) & (against <= 1))
    role = F.when(c("centrality") >= 0.7, "core").when(c("shift") >= 0.3, "turning_point").when(c("historical") >= 0.5, "milestone").when(c("currentness") >= 0.5, "current").otherwise("context")
    return out.withColumn("role", role)


def text_signals(text: Column, phrases: list[str]) -> Column:
    """Which of some phrases a text holds."""
    low = F.lower(text)
    return F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low, p))


def evidence(df: DataFrame, key: str, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """A row for each rule (condition, weight) that holds for a document."""
    rows = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(name).alias("kind"), w.cast("double").alias("weight"))) for name, (c, w) in rules.items()])
    return df.select(key, F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("e")).select(key, "e.*")


def merged_labels(df: DataFrame, model: str, rule: str, overrides: list[tuple[Column, str]]) -> Column:
    """A label from overrides in order, else the model's, else the rule's."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(v)) for c, v in overrides], F.col(model), F.col(rule))


def seeds(df: DataFrame, roles: list[str], least: float, n: int, key: str) -> DataFrame:
    able = F.coalesce(F.col("role").isin(roles) & (F.col("centrality") >= least), F.lit(False))
    # rows that can't be seeds come last and go after the limit: a filter before it would be pushed below the scores and evaluate them again
    return df.orderBy(F.desc(able), F.desc("centrality"), F.desc("currentness"), key).limit(n).where(able)


def coherence(members: DataFrame, by: str, label: str) -> DataFrame:
    """How far one label dominates each cluster, how close the next one comes, outliers, and what that makes the cluster."""
    counts = members.groupBy(by, label).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), label)
    ranked = counts.withColumn("_r", F.row_number().over(w))
    out = ranked.groupBy(by).agg(F.sum("n").alias("members"), F.max(F.when(F.col("_r") == 1, F.col("n"))).alias("_1"), F.coalesce(F.max(F.when(F.col("_r") == 2, F.col("n"))), F.lit(0)).alias("_2"), F.count("*").alias("labels"), F.count_if(F.col("n") == 1).alias("_single"))
    dominance, competition, outliers = (half_up(F.col(x) / F.col(y), 3) for x, y in (("_1", "members"), ("_2", "_1"), ("_single", "members")))
    status = F.when(dominance >= 0.62, "coherent").when((dominance >= 0.5) & (outliers <= 0.3), "mostly_coherent").when(outliers > 0.34, "scattered").when(competition > 0.45, "contested").otherwise("mixed")
    return out.select(by, "members", "labels", dominance.alias("dominance"), competition.alias("competition"), outliers.alias("outliers"), status.alias("status"))


def change_risk(displaced: Column, limited: Column, age: Column, spread: Column) -> Column:
    return _clamped(displaced * 0.40 + limited * 0.25 + age * 0.20 + spread * 0.15)


def greedy_clusters(candidates: DataFrame, label: str, key: str, tags: str, flags: str, neighbour: str, align: str, order: str, top: int = 8, most: int = 120, least: float = 5.0, passes: Column | None = None, weak: Column | None = None, in_order: bool = False) -> DataFrame:
    """(label, seed, member, score): clusters around the newest documents of each label.

    Of each label the ``most`` newest documents are candidates. The newest one that isn't used yet is a seed; others join it,
    best first, up to ``top``, with ``least`` or more of: 2 for the label, 2 for each shared tag (6 at most), 1 for each shared
    flag (3 at most), 3 for a neighbour and 4 times the alignment (4 at most), if they share a tag or are neighbours. Clusters
    of one are dropped, their seeds used up. With a query only documents that pass its gate (``passes``) join, and a weak
    seed (``weak``) is used up alone. ``in_order`` takes members newest first instead of best first. A label's pass is
    sequential but bounded by ``most`` rows; labels lie sorted in their partitions and are walked one after the other there.
    """
    w = Window.partitionBy(label).orderBy(F.desc(order), key)
    rows = candidates.select(F.col(label).alias("_l"), F.col(key).alias("_k"), F.col(tags).alias("_t"), F.col(flags).alias("_f"), F.coalesce(F.col(neighbour), F.lit(0)).cast("int").alias("_b"), F.coalesce(F.col(align), F.lit(0.0)).cast("double").alias("_a"), F.coalesce(passes if passes is not None else F.lit(True), F.lit(False)).alias("_p"), F.coalesce(weak if weak is not None else F.lit(False), F.lit(False)).alias("_w"), F.row_number().over(w).alias("_r")).where(F.col("_r") <= most)

    def walk(names: list, tags_: list[set], flags_: list[set], near: list[int], fits: list[float], gate: list[bool], faint: list[bool]) -> list[tuple]:
        used: set[int] = set()
        out = []
        for i, seed in enumerate(names):
            if i in used:
                continue
            scored = []
            for j in range(len(names)) if not faint[i] else ():
                if j != i and j not in used and gate[j]:
                    shared = len(tags_[i] & tags_[j])
                    value = 2 + min(2 * shared, 6) + min(len(flags_[i] & flags_[j]), 3) + 3 * near[j] + min(4 * fits[j], 4.0)
                    if value >= least and (shared or near[j]):
                        scored.append((-value, names[j], j))
            chosen = (scored if in_order else sorted(scored))[: top - 1]
            used.add(i)
            if chosen:
                used.update(j for *_, j in chosen)
                out += [(seed, seed, 0.0), *((seed, name, float(-s)) for s, name, _ in chosen)]
        return out

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        some = lambda x: set() if x is None else set(x)
        for pdf in batches:
            out = []
            for row in zip(pdf["_l"], pdf["_k"], map(some, pdf["_t"]), map(some, pdf["_f"]), pdf["_b"], pdf["_a"], pdf["_p"], pdf["_w"]):
                if held and held[-1][0] != row[0]:
                    out += [(held[0][0], *x) for x in walk(*map(list, zip(*[h[1:] for h in held])))]
                    held = []
                held.append(row)
            yield pd.DataFrame(out, columns=[label, "seed", "member", "score"])
        if held:
            yield pd.DataFrame([(held[0][0], *x) for x in walk(*map(list, zip(*[h[1:] for h in held])))], columns=[label, "seed", "member", "score"])

    kind = candidates.schema
    named = rows.where("_l IS NOT NULL").repartition("_l").sortWithinPartitions("_l", "_r")
    return named.mapInPandas(walked, f"{label} {kind[label].dataType.simpleString()}, seed {kind[key].dataType.simpleString()}, member {kind[key].dataType.simpleString()}, score double")


def query_gate(align: Column, retrieval: Column, subtopic: Column, matched: Column, asked: Column) -> tuple[Column, Column]:
    """(passes, weak): whether a document may join a cluster of a query, and whether it is too weak to begin one.

    ``align`` and ``retrieval`` are scores, ``subtopic`` and ``matched`` count the query's words that it has, ``asked`` all of them.
    """
    passes = (align >= 0.28) | (retrieval >= 0.82) | (subtopic > 0) | (matched >= F.least(F.lit(2), F.greatest(F.lit(1), asked)))
    return passes, (align < 0.22) & (retrieval < 0.58) & (subtopic == 0) & (matched <= 1)


def dominant_rows(rows: DataFrame, label: str, order: str, key: str, n: int, target: str | None = None) -> DataFrame:
    """The newest ``n`` rows of a label: of ``target``, or else of the commonest one (ties to the smaller); blank labels are one."""
    named = rows.withColumn(label, F.coalesce(F.nullif(F.trim(label), F.lit("")), F.lit("Sin materia")))
    if target is None:
        first = named.groupBy(label).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), label).limit(1).select(label)
        named = named.join(F.broadcast(first), label, "left_semi")
    else:
        named = named.where(F.col(label) == target)
    return named.orderBy(F.desc(order), key).limit(n)


def merged_lines(lines: DataFrame, override: DataFrame, line: str) -> DataFrame:
    """Lines joined where an override says so: members and sources add up, coherence is the mean by members (0.08 less for a join), levels the highest."""
    to = lines.join(override.select(F.col("from_line").alias(line), "to_line"), line, "left").withColumn("line", F.coalesce("to_line", line))
    mean = F.sum((F.col("coherence") * F.col("members")).cast("decimal(18,4)")).cast("double") / F.sum("members")
    parts = F.count("*")
    return to.groupBy("line").agg(F.sum("members").alias("members"), F.sum("sources").alias("sources"), parts.alias("merged"), half_up(mean - F.when(parts > 1, 0.08).otherwise(0.0), 3).alias("coherence"), F.max("level").alias("level"))




def query_alignment(coverage: Column, retrieval: Column, intent: Column, off_topic: Column, stale: Column) -> Column:
    """How a cluster fits a query: coverage .42, retrieval .34 and the intent's boost; less for what is off topic or stale, 1.2 at most."""
    raw = (coverage * 0.42 + retrieval * 0.34 + intent) * F.when(off_topic, 0.58).otherwise(1.0) * F.when(stale, 0.72).otherwise(1.0)
    return half_up(F.least(F.lit(1.2), raw), 3)


def direct_hits(hits: DataFrame, by: str, key: str, score: str, coverage: str) -> DataFrame:
    """Hits with 1.45 * (score / best) + 2.2 * coverage, and whether a query's best one is strong: at least .9 of the best score, .04 ahead."""
    w = Window.partitionBy(by)
    normed = hits.withColumn("_n", F.coalesce(F.col(score) / F.nullif(F.max(score).over(w), F.lit(0.0)), F.lit(0.0)))
    value = half_up(F.col("_n") * 1.45 + F.col(coverage) * 2.2, 4)
    ordered = w.orderBy(F.desc("value"), key)
    out = normed.withColumn("value", value).withColumn("place", F.row_number().over(ordered)).withColumn("_gap", F.col("_n") - F.lead("_n").over(ordered))
    return out.withColumn("strong", (F.col("place") == 1) & (F.col("_n") >= 0.9) & (F.coalesce("_gap", F.lit(1.0)) >= 0.04)).drop("_n", "_gap")


def pivots(members: DataFrame, by: str, key: str, modifying: str, stabilising: str, ts: str) -> DataFrame:
    """The member on which each cluster turns: most modifying relations, then most stabilising, then newest, then the smaller key."""
    w = Window.partitionBy(by).orderBy(F.desc(modifying), F.desc(stabilising), F.desc(ts), key)
    return members.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def visible_representatives(clusters: DataFrame, pivot: str, newest: str, displaced: str) -> DataFrame:
    """Which document stands for a cluster: its pivot, or its newest one where the pivot is displaced."""
    return clusters.withColumn("representative", F.when(F.col(displaced), F.col(newest)).otherwise(F.col(pivot)))


def presented(lines: DataFrame, family: str, key: str, score: str, momentum: str, anchor: str) -> DataFrame:
    """Lines in the order in which they are shown: 0.7 * score + 0.3 * momentum, a third less behind the leader of their family, anchors first."""
    base = F.col(score) * 0.7 + F.col(momentum) * 0.3
    w = Window.partitionBy(family)
    out = lines.withColumn("_b", base).withColumn("_lead", F.row_number().over(w.orderBy(F.desc("_b"), key)) == 1)
    value = half_up(F.when(F.col("_lead"), F.col("_b")).otherwise(F.col("_b") * 2 / 3), 4)
    return out.withColumn("shown_score", value).drop("_b", "_lead").orderBy(F.col(anchor).desc(), F.desc("shown_score"), key)
