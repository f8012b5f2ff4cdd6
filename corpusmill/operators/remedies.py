"""Remedies for faulty rows: labels in a normal form, writes that lose no other write, blocked rows, catalogs, decisions, key pools, vector stores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import fold, squeeze
from corpusmill.operators.aggregates import half_up
from corpusmill.operators.joins import best_per_key

# What may be done to labels, in this order, and origins of rows whose source is lost.
KINDS = ["trim_whitespace", "snake_case_to_spaces", "collapse_whitespace", "dedupe_normalized_duplicates"]
LOST_ORIGINS = ["missing_kv", "sin_kv", "error_sin_KV_source"]
# How roles are given where a document has several, and how they are read.
GIVEN = ["representative", "core", "pivot", "influential"]
READ = ["representative", "pivot", "core", "influential"]


def _steps(kinds: list[str]) -> dict[str, object]:
    ends = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    all_steps = {KINDS[0]: ends, KINDS[1]: lambda x: F.replace(x, F.lit("_"), F.lit(" ")), KINDS[2]: squeeze}
    return {k: f for k, f in all_steps.items() if k in kinds}


def normal_labels(labels: Column, kinds: list[str] = KINDS) -> Column:
    """Struct of labels in their normal form, the kinds of change that this took (in the order of KINDS), and ``empty``.

    If a label has nothing left, ``empty`` is true and the labels stay as they came; kinds are those up to that label. Of
    labels that are the same but for case, marks and underscores the first stays. A null label counts as an empty text.
    """
    steps = _steps(kinds)
    given = F.transform(labels, lambda x: F.coalesce(x, F.lit("")))
    through = lambda n: lambda x: reduce(lambda v, f: f(v), list(steps.values())[:n], x)
    clean = through(len(steps))
    values = F.transform(given, clean)
    hole = F.array_position(F.transform(values, lambda x: F.trim(x) == ""), True)
    looked = F.when(hole > 0, F.slice(given, 1, F.greatest(hole, F.lit(1)).cast("int"))).otherwise(given)
    same = F.transform(values, lambda x: squeeze(fold(F.replace(x, F.lit("_"), F.lit(" ")))))
    kept = F.filter(values, lambda x, i: F.array_position(same, F.element_at(same, i + 1)) == i + 1) if KINDS[3] in kinds else values
    changes = lambda n: lambda x: through(n)(x) != through(n + 1)(x)
    applied = [F.when(F.exists(looked, changes(n)), F.lit(kind)) for n, kind in enumerate(steps)]
    seen = F.slice(same, 1, F.size(looked) - F.when(hole > 0, 1).otherwise(0)) if KINDS[3] in kinds else F.array().cast("array<string>")
    applied.append(F.when(F.size(F.array_distinct(seen)) < F.size(seen), F.lit(KINDS[3])))
    return F.struct(
        F.when(hole > 0, given).otherwise(kept).alias("labels"), F.filter(F.array(*applied), lambda x: x.isNotNull()).alias("applied"), (hole > 0).alias("empty")
    )


def swapped(table: DataFrame, changes: DataFrame, key: str, column: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(table, outcome) of the first ``most`` changes by key (key, ``seen``, ``new``): a row changes if it still holds what was seen.

    ``outcome`` is applied, conflict (it holds something else) or missing. Changes to what is there already are none.
    """
    batch = changes.where(~F.col("seen").eqNullSafe(F.col("new"))).orderBy(key).limit(most).select(key, F.col("seen").alias("_seen"), F.col("new").alias("_new"), F.lit(True).alias("_asked"))
    holds = F.coalesce("_asked", F.lit(False)) & F.col(column).eqNullSafe(F.col("_seen"))
    result = table.join(batch, key, "left").withColumn(column, F.when(holds, F.col("_new")).otherwise(F.col(column))).select(table.columns)
    held = table.join(batch.select(key), key, "left_semi").select(key, F.col(column).alias("_held"), F.lit(True).alias("_there"))
    outcome = F.when(F.col("_there").isNull(), "missing").when(F.col("_held").eqNullSafe(F.col("_seen")), "applied").otherwise("conflict")
    return result, batch.join(held, key, "left").select(key, outcome.alias("outcome"))


def format_noise(df: DataFrame, key: str, text: str, signs: dict[str, str], ids: int = 50) -> DataFrame:
    """For each sign the rows whose text holds it, and the first ``ids`` of their keys."""
    marked = df.select(key, F.explode(F.filter(F.array(*[F.when(F.contains(F.coalesce(text, F.lit("")), F.lit(s)), F.lit(name)) for name, s in signs.items()]), lambda x: x.isNotNull())).alias("sign"))
    first = best_per_key(marked, ["sign"], [F.col(key)], ids).groupBy("sign").agg(F.array_sort(F.collect_list(key)).alias("ids"))
    every = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in signs])).alias("sign"))
    counts = every.join(marked.groupBy("sign").agg(F.count("*").alias("n")), "sign", "left").join(first, "sign", "left")
    return counts.select("sign", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("ids", F.array().cast(first.schema["ids"].dataType)).alias("ids"))


def blocked(df: DataFrame, core: list[str], topic: str, labels: str, sources: str, flags: str, url: str, origin: str, may_write: bool = False, apply: bool = False) -> DataFrame:
    """Rows that lack core texts, with what is missing, the way to mend them, its risk, and what is done now.

    ``labels``, ``sources`` and ``flags`` are numbers of such values. One missing text is written anew from a row's other
    values if these are strong; else the row is read again from its source if it has one; else somebody has to look.
    """
    empty = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    missing = F.filter(F.array(*[F.when(empty(c), F.lit(c)) for c in core]), lambda x: x.isNotNull())
    n = F.size("missing")
    strong = ~empty(topic) & (F.col(labels) >= 2) & ((F.col(sources) > 0) | (F.col(flags) >= 2))
    found = ~empty(url) | (~empty(origin) & ~F.trim(origin).isin(LOST_ORIGINS))
    strategy = F.when((n == 1) & strong, "regenerate_from_existing_metadata").when(found, "regenerate_from_source").otherwise("needs_manual_semantic_review")
    risk = F.when((n == 1) & strong, "medium").when(found & (n == len(core)), "medium").otherwise("high")
    now = F.when((F.col("strategy") != "needs_manual_semantic_review") & F.lit(apply and not may_write), "skip_until_write_guard_satisfied").otherwise(F.col("strategy"))
    return df.withColumn("missing", missing).where(n > 0).withColumns({"strategy": strategy, "risk": risk}).withColumn("action", now)


def without_malformed(catalog: DataFrame, links: DataFrame, key: str, link: str, bad: Column) -> tuple[DataFrame, DataFrame]:
    """(catalog, links) without entries that are malformed and without the links to them; links to nothing stay."""
    wrong = catalog.where(F.coalesce(bad, F.lit(False))).select(key)
    return catalog.join(wrong, key, "left_anti"), links.join(wrong.withColumnRenamed(key, link), link, "left_anti")


def delegated(cases: DataFrame, incident: str, target: str, rules: DataFrame) -> DataFrame:
    """Cases with the verdict of a decision table (incident, target, allowed, compatibility; a row for each pair).

    A case without an incident is only looked at, one without a rule blocked; a rule that forbids says which of the two.
    """
    table = rules.select(F.col("incident").alias("_i"), F.col("target").alias("_t"), "allowed", "compatibility")
    met = cases.join(table, F.col(incident).eqNullSafe(F.col("_i")) & F.col(target).eqNullSafe(F.col("_t")), "left")
    verdict = F.when(F.col(incident).isNull(), "preview_only").when(F.col("allowed").isNull(), "blocked_by_semantic_gap").when(F.col("allowed"), "delegated").when(F.col("compatibility") == "preview_only", "preview_only").otherwise("blocked_by_semantic_gap")
    return met.withColumn("verdict", verdict).drop("_i", "_t", "allowed", "compatibility")


def failed_keys(pool: DataFrame, failures: DataFrame, key: str, as_of: Column, hours: int = 12) -> DataFrame:
    """A pool of keys (key, status, exhausted_until, last_used) after failures (key, reason; one a key): quota rests, blocked ends, error doesn't matter."""
    met = pool.join(failures.select(key, "reason"), key, "left")
    status = F.when(F.col("reason") == "quota", "exhausted").when(F.col("reason") == "blocked", "blocked").when(F.col("reason").isNotNull(), "active").otherwise(F.col("status"))
    until = F.when(F.col("reason") == "quota", as_of + F.make_dt_interval(hours=F.lit(hours))).when(F.col("reason").isNull(), F.col("exhausted_until"))
    return met.withColumns({"status": status, "exhausted_until": until}).select(pool.columns)


def chosen_keys(pool: DataFrame, by: str, key: str, uses: DataFrame, limit: int, as_of: Column) -> DataFrame:
    """For each pool the free key that was used longest ago, or else the seconds until one is free; neither if all are blocked.

    A key waits while it is exhausted, and until the next minute if it was used ``limit`` times in this one (``uses``: key, ts).
    """
    minute = F.date_trunc("minute", as_of)
    busy = uses.where(F.date_trunc("minute", "ts") == minute).groupBy(key).agg((F.count("*") >= limit).alias("_busy"))
    until = F.when(F.col("exhausted_until") > as_of, F.col("exhausted_until")).when(F.col("_busy"), minute + F.make_dt_interval(mins=F.lit(1)))
    open_ = (F.col("status") != "blocked") | F.col("status").isNull()
    rows = pool.join(busy, key, "left").withColumn("_until", until).withColumn("_open", open_)
    free = F.when(F.col("_open") & F.col("_until").isNull(), F.struct(F.coalesce("last_used", F.lit("1970-01-01").cast("timestamp")), F.col(key).alias("k")))
    wait = F.min(F.when(F.col("_open"), F.col("_until")))
    seconds = F.greatest(F.lit(1), F.ceil((F.unix_micros(F.col("_wait").cast("timestamp")) - F.unix_micros(as_of.cast("timestamp"))) / 1e6)).cast("int")
    out = rows.groupBy(by).agg(F.min(free).alias("_free"), wait.alias("_wait"))
    chosen = F.col("_free.k")
    return out.select(by, chosen.alias("chosen"), F.when(chosen.isNull() & F.col("_wait").isNotNull(), seconds).alias("retry_after"))


def store_findings(table: DataFrame, store: DataFrame, key: str, required: list[str], tags: str, model: str) -> DataFrame:
    """What is wrong in a vector store, over all rows of its table: vectors missing, metadata with gaps, another model; severity by share.

    ``store`` has the key, the required texts, an array of tags (two at least are asked for) and the model, which is compared where both have one.
    """
    empty = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    full = F.size(F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")) >= 2
    gap = reduce(Column.__or__, [empty(c) for c in required], ~full)
    held = store.select(key, gap.alias("_gap"), F.nullif(F.trim(model), F.lit("")).alias("_model"), F.lit(True).alias("_there"))
    met = table.select(key, F.col(model).alias("_own")).join(held, key, "left")
    there = F.col("_there").isNotNull()
    counts = met.agg(F.count("*").alias("rows"), F.count_if(~there).alias("missing_vector"), F.count_if(there & F.col("_gap")).alias("metadata_gap"), F.count_if(there & (F.col("_model") != F.col("_own"))).alias("model_mismatch"))
    kinds = ["missing_vector", "metadata_gap", "model_mismatch"]
    each = counts.select("rows", F.explode(F.array(*[F.struct(F.lit(k).alias("finding"), F.col(k).alias("n")) for k in kinds])).alias("x")).select("rows", "x.finding", "x.n").where("n > 0")
    return each.select("finding", "n", F.when((F.col("finding") != "model_mismatch") & (F.col("n") >= F.ceil(F.col("rows") * F.lit(0.2))), "high").otherwise("medium").alias("severity"))


def clusters_by_query(clusters: DataFrame, members: DataFrame, alignment: DataFrame, by: str, key: str) -> DataFrame:
    """``clusters`` with ``query_score``: the alignment of their first five different members by ``place``, the first by 1.4."""
    places = members.groupBy(by, key).agg(F.min("place").alias("place"))
    first = places.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("place", key))).where("_r <= 5")
    worth = F.coalesce("score", F.lit(0.0)) * F.when(F.col("_r") == 1, 1.4).otherwise(1.0)
    sums = first.join(alignment.select(key, "score"), key, "left").groupBy(by).agg(half_up(F.sum(worth.cast("decimal(20,8)")).cast("double"), 4).alias("query_score"))
    return clusters.join(sums, by, "left").withColumn("query_score", F.coalesce("query_score", F.lit(0.0)))


def key_documents(candidates: DataFrame, line: str, key: str, most: int = 5) -> DataFrame:
    """The documents to read of each line, with their role and place.

    ``candidates``: line, key, role, place (of influential ones), weight, priority, date; a document may have several roles
    and gets the first of GIVEN. Influential ones fill up to ``most``; all are read by role, weight, priority, newest date, key.
    """
    at = lambda roles, c: F.array_position(F.array(*[F.lit(r) for r in roles]), c)
    one = candidates.groupBy(line, key).agg(F.min_by("role", at(GIVEN, F.col("role"))).alias("role"), F.min("place").alias("place"), F.max("weight").alias("weight"), F.max("priority").alias("priority"), F.max("date").alias("date"))
    others = one.where("role <> 'influential'")
    held = others.groupBy(line).agg(F.count("*").alias("_held"))
    w = Window.partitionBy(line).orderBy("place", key)
    fill = one.where("role = 'influential'").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).join(held, line, "left").where(F.col("_r") + F.coalesce("_held", F.lit(0)) <= most)
    order = Window.partitionBy(line).orderBy(at(READ, F.col("role")), F.desc("weight"), F.desc("priority"), F.desc("date"), key)
    return others.unionByName(fill.select(others.columns)).withColumn("reading_place", F.row_number().over(order)).where(F.col("reading_place") <= most).select(line, key, "role", "reading_place")
