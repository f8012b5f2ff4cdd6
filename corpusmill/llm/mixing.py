"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents with the same set of sources form a pattern. Token capacity flows from patterns to the quotas of their sources;
a pattern's tokens can be used several times, each time at a higher price, so repetition is spread as evenly as quotas
allow. What flows out of a pattern says how often all of its documents are taken and which share once more; the share is
filled with documents in the order of a seeded hash. Everything but the flow is aggregation; the flow of each connected
group of patterns and sources is solved where the group is, from its totals.
"""

from __future__ import annotations

from heapq import heapify, heappop, heapreplace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import WORD_PATTERN, written
from corpusmill.llm.components import components

#: Documents of a pattern are counted in so many ranges of their hash, so that only one range needs an order.
RANGES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def min_cost_flow(capacity: list[int], members: list[list[int]], quota: list[int], repeats: int) -> list[dict[int, int]]:
    """Tokens routed from each pattern to its sources, by source.

    ``capacity``: a pattern's tokens, usable ``repeats`` times at prices 0, 1, 2, ...; ``members``: its sources;
    ``quota``: what each source takes at most. As much as possible flows, at the least price: along the cheapest path of
    the residual graph again and again. Only arcs that exist are held.
    """
    flow: list[dict[int, int]] = [{} for _ in capacity]
    users: list[set[int]] = [set() for _ in quota]  # patterns that flow to a source
    left, used = list(quota), [0] * len(capacity)
    # a path starts at the pattern whose next token is cheapest; giving back on the way is free, so its price is that token's
    queue = [(0, i) for i, size in enumerate(capacity) if size > 0]
    heapify(queue)
    while queue:
        level, first = queue[0]
        if level >= repeats:
            break
        # pattern -> source (-> pattern that gives back -> source ...), by breadth
        came: dict[int, tuple[int, int | None]] = {}  # source: (pattern before it, source before that)
        reached, at, last = {first}, [(first, None)], None
        for pattern, before in at:
            for s in members[pattern]:
                if s in came:
                    continue
                came[s] = pattern, before
                if left[s] > 0:
                    last = s
                    break
                for p in users[s]:
                    if p not in reached:
                        reached.add(p)
                        at.append((p, s))
            if last is not None:
                break
        if last is None:
            heappop(queue)  # nothing is left that this pattern can reach, and that stays so
            continue
        path, s = [], last
        while s is not None:
            pattern, before = came[s]
            path.append((s, pattern, before))
            s = before
        amount = min(left[last], capacity[first] * (level + 1) - used[first], *[flow[p][before] for _, p, before in path if before is not None])
        for s, p, before in path:
            flow[p][s] = flow[p].get(s, 0) + amount
            users[s].add(p)
            if before is not None:
                flow[p][before] -= amount
                if not flow[p][before]:
                    users[before].discard(p)
        left[last] -= amount
        used[first] += amount
        if used[first] == capacity[first] * (level + 1):
            heapreplace(queue, (level + 1, first))
    return flow


def source_targets(sized: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """``_source``, ``_source_size`` and ``_target`` from rows of ``_source`` and ``_size`` (a row for each source of a document).

    Sources in code point order (null last) have the weights in turn and share all tokens by them; a target stops at
    ``repeats`` times its source's size, and the rest is shared anew by weight until no target is above. The order comes
    from a range sort, whose partitions' counts alone go to the driver.
    """
    totals = sized.groupBy("_source").agg(F.sum("_size").alias("_source_size"))
    ordered = totals.orderBy(F.col("_source").asc_nulls_last()).select("*", F.monotonically_increasing_id().alias("_at"))
    ordered = written(ordered.select("_source", "_source_size", F.shiftright("_at", 33).cast("int").alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_place")), "sources")
    before, offset = 0, {}
    for r in sorted(ordered.groupBy("_part").count().collect()):
        offset[r["_part"]], before = before, before + r["count"]
    starts = F.create_map(*[F.lit(x) for p in offset.items() for x in p]) if offset else F.create_map(F.lit(0), F.lit(0))
    place = F.col("_place") + F.element_at(starts, F.col("_part"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = written(ordered.select("_source", "_source_size", weight.alias("_weight"), (F.col("_source_size") * repeats).cast("double").alias("_most")), "weights")
    total, shared = rows.agg(F.sum("_source_size"), F.sum("_weight")).first()
    unit, capped = (total or 0) / shared if shared else 0.0, -1
    while True:
        full = F.col("_most") <= F.col("_weight") * F.lit(unit)
        n, taken, rest = rows.agg(F.count_if(full), F.sum(F.when(full, F.col("_most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("_weight")))).first()
        if n == capped or not rest:
            break
        capped, unit = n, (total - taken) / rest
    return rows.select("_source", "_source_size", F.least("_most", F.col("_weight") * F.lit(unit)).alias("_target"))


def _solve(repeats: int):
    def solve(group: pd.DataFrame) -> pd.DataFrame:
        """group: a row for each pattern and source of one connected group."""
        sources = {s: i for i, s in enumerate(sorted(set(group["_s"])))}
        quota = [0] * len(sources)
        for s, t in zip(group["_s"], group["_target"]):
            quota[sources[s]] = round(t)
        patterns = {p: i for i, p in enumerate(sorted(set(group["_pattern"])))}
        capacity, members = [0] * len(patterns), [[] for _ in patterns]
        for p, s, c in zip(group["_pattern"], group["_s"], group["_tokens"]):
            capacity[patterns[p]] = int(c)
            members[patterns[p]].append(sources[s])
        out = [sum(x.values()) for x in min_cost_flow(capacity, members, quota, repeats)]
        return pd.DataFrame({"_pattern": list(patterns), "_flow": out, "_room": capacity})

    return solve


def mix(docs: DataFrame, sources: Column, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", seed: int = 17) -> DataFrame:
    """``document`` (the row), size, copies (how often the mix takes it, 0 to ``repeats``), sources and, for the first of these, source_size and target.

    ``sources`` is a string or an array of strings (a document in several sources; a null in it is a
    source without name, and so is that of a document in none).
    A null text has size 0; texts of any length are counted whole. Reruns agree: the order of documents is a hash of seed,
    id and text. Rows that agree in both are taken alike. The row keeps all of its columns, whatever their names. A
    connected group of overlapping sources is solved in one task, from one row for each pattern and source: as many as
    there are combinations of sources, whatever the number of documents.
    """
    kind = docs.select(sources.alias("s")).schema["s"].dataType.typeName()
    several = F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>")))) if kind == "array" else F.array(sources.cast("string"))
    order = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))), 1, 15), 16, 10).cast("long")
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), several.alias("_sources"), word_count(F.col(text_col)).alias("_size"), order.alias("_h"))
    # a null source has a name that no other has; the name of a pattern is built from its sources' names
    named = F.transform("_sources", lambda s: F.coalesce(F.concat(F.lit("="), s), F.lit("null")))
    marked = marked.withColumn("_pattern", F.to_json(named))
    small = written(marked.select("_sources", "_pattern", "_size", "_h"), "sizes")
    targets = written(source_targets(small.select(F.explode_outer("_sources").alias("_source"), "_size"), weights, repeats), "targets")
    patterns = small.groupBy("_pattern", "_sources").agg(F.sum("_size").alias("_tokens"))
    arcs = patterns.select("_pattern", "_tokens", F.explode_outer("_sources").alias("_source"))
    t = targets.withColumnRenamed("_source", "_name")
    arcs = written(arcs.join(t, F.col("_source").eqNullSafe(F.col("_name"))).select("_pattern", "_tokens", F.coalesce(F.concat(F.lit("="), "_source"), F.lit("null")).alias("_s"), "_target"), "arcs")
    if kind == "array":
        ends = arcs.select(F.xxhash64("_pattern", F.lit(0)).alias("a"), F.xxhash64("_s", F.lit(1)).alias("b"))
        group = components(ends)
        arcs = arcs.withColumn("a", F.xxhash64("_pattern", F.lit(0))).join(group, F.col("a") == F.col("id"), "left").withColumn("_group", F.coalesce("component", "a"))
    else:
        arcs = arcs.withColumn("_group", F.xxhash64("_s"))
    flows = arcs.select("_group", "_pattern", "_s", "_tokens", "_target").groupBy("_group").applyInPandas(_solve(repeats), "_pattern string, _flow long, _room long")
    full = F.when(F.col("_room") > 0, F.floor(F.col("_flow") / F.col("_room"))).otherwise(F.lit(1)).cast("int")
    flows = written(flows.withColumn("_full", full).withColumn("_rest", F.greatest(F.col("_flow") - F.col("_full") * F.col("_room"), F.lit(0))), "flows")
    # the range of hashes in which the rest of the flow ends, then the last document that fits by half at least
    width = (1 << 60) // RANGES
    ranges = small.groupBy("_pattern", F.floor(F.col("_h") / width).cast("int").alias("_range")).agg(F.sum("_size").alias("_tokens"))
    upto = F.sum("_tokens").over(Window.partitionBy("_pattern").orderBy("_range"))
    ranges = ranges.withColumn("_before", upto - F.col("_tokens")).join(flows.select("_pattern", "_rest"), "_pattern")
    last = ranges.where((F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("_tokens"))).select("_pattern", "_range", "_before", "_rest")
    inside = small.withColumn("_range", F.floor(F.col("_h") / width).cast("int")).join(last, ["_pattern", "_range"])
    sofar = F.sum("_size").over(Window.partitionBy("_pattern").orderBy("_h")) + F.col("_before")
    cut = inside.withColumn("_sofar", sofar).where(F.col("_sofar") - F.col("_size") / 2 <= F.col("_rest")).groupBy("_pattern").agg(F.max("_h").alias("_h_last"))
    cut = last.select("_pattern", (F.col("_range").cast("long") * width - 1).alias("_h_low")).join(cut, "_pattern", "left").select("_pattern", F.coalesce("_h_last", "_h_low").alias("_cut"))
    # written, so that its size is known and Spark chooses how to join it
    plan = written(flows.join(cut, "_pattern", "left").select(F.col("_pattern").alias("_p"), "_full", F.coalesce("_cut", F.lit(-1)).alias("_cut")), "plan")
    copies = F.col("_full") + F.when((F.col("_h") <= F.col("_cut")) & (F.col("_full") < repeats), 1).otherwise(0)
    out = marked.join(plan, F.col("_pattern") == F.col("_p"), "left").withColumn("_copies", F.coalesce(copies, F.lit(0)))
    first = F.when(F.size("_sources") > 0, F.element_at("_sources", 1))
    out = out.withColumn("_first", first).join(t, F.col("_first").eqNullSafe(F.col("_name")), "left")
    return out.select("document", F.col("_size").alias("size"), F.col("_copies").alias("copies"), F.col("_sources").alias("sources"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"))
