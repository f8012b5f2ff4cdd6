"""How well the documents of a line belong together, what is wrong with it, and what to do about it.

``members`` has a row for each document of a line: ``score`` (its influence) and ``relations`` (a count). ``lines`` has a row
for each line: ``density`` (0 to 1), ``bucket`` (what its relations mostly do), ``title`` and ``representative``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.aggregates import half_up
from corpusmill.operators.clusters import same_title_pairs
from corpusmill.operators.graph import components
from corpusmill.operators.joins import best_per_key
from corpusmill.sources.tables import checkpointed

# Weights and limits of the signals.
COHESION = {"density": 0.55, "dominance": 0.2, "source": 0.15, "related": 0.1}
FRAGMENTATION = {"dispersion": 0.45, "outliers": 0.3, "competition": 0.15}
ADJUSTING, OUTLIER_SHARE, OUTLIER_FLOOR, OUTLIERS, NOISE = 0.1, 0.7, 0.35, 0.22, 0.4
# Up to how many items sets of them meet by their subsets.
NARROW_LINE, NARROW_DOCUMENT = 6, 12


def _sum(weights: dict[str, float]) -> Column:
    return reduce(Column.__add__, [F.col(name) * w for name, w in weights.items()])


def _capped(x: Column) -> Column:
    return half_up(F.least(F.lit(1.0), x), 2)


def is_outlier(score: Column, density: Column) -> Column:
    """A document that weighs less than 0.7 of its line's density, and than 0.35 in any case."""
    return score < F.greatest(density * OUTLIER_SHARE, F.lit(OUTLIER_FLOOR))


def signals(lines: DataFrame, line: str, members: DataFrame, descriptors: DataFrame, descriptor: str, sources: DataFrame, source: str) -> DataFrame:
    """``cohesion``, ``dispersion``, ``outliers``, ``noise``, ``fragmentation`` and ``status`` (cohesive, mixed, fragmented) of each line.

    ``descriptors`` and ``sources`` have a row for each mention inside a line. Lines without documents are left out; one
    without mentions has nothing that dominates.
    """
    counts = descriptors.groupBy(line, descriptor).agg(F.count("*").alias("_n"))
    place = F.row_number().over(Window.partitionBy(line).orderBy(F.desc("_n"), descriptor))
    first = lambda n: F.max(F.when(F.col("_r") == n, F.col("_n"))).alias(f"_{n}")
    best = counts.withColumn("_r", place).where("_r <= 2").groupBy(line).agg(first(1), first(2))
    top = sources.groupBy(line, source).agg(F.count("*").alias("_n")).groupBy(line).agg(F.max("_n").alias("_source"))
    known = members.join(lines.select(line, "density"), line)
    many = known.groupBy(line).agg(F.count("*").alias("members"), F.count_if(F.col("relations") > 0).alias("_related"), F.count_if(is_outlier(F.col("score"), F.col("density"))).alias("_out"))
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("members")
    out = many.join(lines.select(line, "density", "bucket"), line).join(best, line, "left").join(top, line, "left")
    out = out.select(line, "members", "density", "bucket", share("_1").alias("dominance"), (F.coalesce(F.col("_2"), F.lit(0)) / F.greatest(F.coalesce(F.col("_1"), F.lit(0)), F.lit(1))).alias("competition"), share("_source").alias("source"), share("_related").alias("related"), half_up(share("_out"), 2).alias("outliers"))
    out = out.withColumn("cohesion", half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), _sum(COHESION))), 2)).withColumn("dispersion", half_up(1 - F.col("cohesion"), 2))
    out = out.withColumn("noise", _capped((1 - F.col("dominance")) * 0.7 + F.col("competition") * 0.3))
    out = out.withColumn("fragmentation", _capped(_sum(FRAGMENTATION) + F.when(F.col("bucket") == "adjusts", ADJUSTING).otherwise(0.0)))
    broken = (F.col("fragmentation") >= 0.62) | ((F.col("dispersion") >= 0.5) & (F.col("outliers") >= 0.3))
    mixed = (F.col("dispersion") >= 0.34) | (F.col("noise") >= 0.45) | (F.col("outliers") >= OUTLIERS)
    return out.select(line, "members", "cohesion", "dispersion", "outliers", "noise", "fragmentation", F.when(broken, "fragmented").when(mixed, "mixed").otherwise("cohesive").alias("status"))


def findings(found: DataFrame, line: str) -> DataFrame:
    """One row for each line that is fragmented (high) or is mixed and has outliers (medium), with the figures that say so."""
    kind = F.when(F.col("status") == "fragmented", "fragmentation").when((F.col("status") == "mixed") & (F.col("outliers") >= OUTLIERS), "outliers")
    return found.select(line, kind.alias("finding"), F.when(kind == "fragmentation", "high").otherwise("medium").alias("severity"), "cohesion", "dispersion", "outliers", "noise", "fragmentation").where("finding IS NOT NULL")


def reassignments(outliers: DataFrame, line: str, key: str, items: DataFrame, line_items: DataFrame) -> DataFrame:
    """For each outlier (line, key) the other line that has most of its items: line, key, ``target`` and ``shared``; ties to the smaller line.

    ``items`` are (key, item), ``line_items`` the top items of lines (line, item). Different sets of items of documents meet an
    index of the subsets of lines' items, each with its two smallest lines: one may be the document's own. Sets of documents
    with more than ``NARROW_DOCUMENT`` items, and lines with more than ``NARROW_LINE``, meet item by item.
    """
    said = F.col("item").cast("string").alias("item")
    whole = F.array_sort(F.collect_set("item"))
    tags = line_items.select(F.col(line).alias("target"), said).groupBy("target").agg(whole.alias("_tags"))
    classes = checkpointed(best_per_key(tags, ["_tags"], [F.col("target")], 2))
    docs = checkpointed(outliers.select(line, key).join(items.select(key, said), key).groupBy(line, key).agg(whole.alias("_items")))
    sets = docs.select("_items").distinct()
    few, wide = F.size("_tags") <= NARROW_LINE, F.size("_items") > NARROW_DOCUMENT
    index = best_per_key(classes.where(few).select("target", F.explode(subsets(F.col("_tags"), NARROW_LINE)).alias("_s")), ["_s"], [F.col("target")], 2)
    index = index.groupBy("_s").agg(F.collect_list("target").alias("_t"))
    asked = sets.where(~wide).select("_items", F.explode(subsets(F.col("_items"), NARROW_LINE)).alias("_s"))
    near = asked.join(index, "_s").select("_items", F.size("_s").cast("long").alias("shared"), F.explode("_t").alias("target"))
    each = lambda df, c, *keep: df.select(*keep, c, F.explode(c).alias("item"))
    by_item = lambda some, lines: each(some, "_items").join(each(lines, "_tags", "target"), "item").groupBy("_items", "target").agg(F.count("*").alias("shared")).select("_items", "shared", "target")
    found = near.unionByName(by_item(sets.where(wide), classes)).unionByName(by_item(sets.where(~wide), classes.where(~few)))
    scored = found.groupBy("_items", "target").agg(F.max("shared").alias("shared"))
    first = best_per_key(scored, ["_items"], [F.desc("shared"), F.col("target")], 2)
    first = first.groupBy("_items").agg(F.array_sort(F.collect_list(F.struct((-F.col("shared")).alias("n"), "target"))).alias("_best"))
    other = F.get(F.filter("_best", lambda x: x["target"] != F.col(line)), F.lit(0))
    return docs.join(first, "_items").select(line, key, other.alias("_o")).where("_o IS NOT NULL").select(line, key, "_o.target", (-F.col("_o.n")).alias("shared"))


def subsets(items: Column, most: int) -> Column:
    """Subsets of an array of different strings with one item or more, ``most`` at most, in the array's order."""
    longer = lambda found, x: F.transform(F.filter(found, lambda s: F.size(s) < most), lambda s: F.concat(s, F.array(x)))
    all_ = F.aggregate(items, F.array(F.array().cast("array<string>")), lambda found, x: F.concat(found, longer(found, x)))
    return F.filter(all_, lambda s: F.size(s) > 0)


def parts(members: DataFrame, line: str, key: str, items: DataFrame) -> DataFrame:
    """Into how many parts each line falls whose documents share no items with each other, and the size of the largest.

    Documents of a line that share an item are linked to the smallest of them and never in pairs.
    """
    named = lambda value: F.struct(F.col(line).alias("line"), F.col(value).alias("key"))
    links = members.select(line, key).join(items.select(key, "item").where("item IS NOT NULL").distinct(), key)
    first = links.groupBy(line, "item").agg(F.min(key).alias("_first"))
    found = components(links.join(first, [line, "item"]).select(named(key).alias("a"), named("_first").alias("b")).distinct(), "a", "b")
    sizes = found.groupBy(F.col("node.line").alias(line), "root").agg(F.count("*").alias("n")).groupBy(line).agg(F.count("*").alias("_parts"), F.max("n").alias("_largest"))
    # documents without items are parts of their own
    alone = members.select(line, key).join(links.select(line, key).distinct(), [line, key], "left_anti").groupBy(line).agg(F.count("*").alias("_alone"))
    both = sizes.join(alone, line, "full_outer").fillna(0, ["_parts", "_largest", "_alone"])
    return both.select(line, (F.col("_parts") + F.col("_alone")).alias("parts"), F.greatest("_largest", F.lit(1)).alias("largest"))


def actions(found: DataFrame, lines: DataFrame, line: str, key: str, members: DataFrame, items: DataFrame, most: int | None = 12) -> DataFrame:
    """What to do: ``action``, line, ``other``, ``detail``, ``confidence``, ``impact`` and ``risk``; the surest ``most``, or all.

    Lines of one title are merged, by pairs that share enough and as a group (``detail``: lines); fragmented ones are split
    (``detail``: parts that share nothing); outliers go to other lines (``detail``: outliers for whom there is one); and noise
    in labels is normalised. ``lines`` has ``tags`` and ``sources``, arrays of each line's top items.
    """
    sure = lambda x: half_up(F.least(F.lit(1.0), x), 2)
    row = lambda df, action, confidence, impact, risk, other=None, detail=None: df.select(
        F.lit(action).alias("action"), F.col(line), (F.lit(None).cast("long") if other is None else F.col(other).cast("long")).alias("other"), (F.lit(None).cast("long") if detail is None else F.col(detail).cast("long")).alias("detail"),
        confidence.alias("confidence"), F.lit(impact).alias("impact"), (risk if isinstance(risk, Column) else F.lit(risk)).alias("risk"),
    )
    # four kinds of actions read the signals, three the lines
    found, lines = checkpointed(found), checkpointed(lines)
    pairs = same_title_pairs(lines, line, "title", {"tags": "tags", "sources": "sources"}, digits=2)
    titles = lines.groupBy(F.lower("title").alias("_t")).agg(F.count("*").alias("_n"), F.min(line).alias(line)).where("_n > 1")
    broken = found.where("status = 'fragmented'").select(line, "fragmentation")
    split = broken.join(parts(members.join(broken.select(line), line, "left_semi"), line, key, items), line, "left")
    outlying = found.where(F.col("outliers") >= OUTLIERS).select(line, F.col("outliers").alias("_share"))
    out_docs = members.join(outlying, line).join(lines.select(line, "density"), line).where(is_outlier(F.col("score"), F.col("density")))
    tops = lines.select(line, F.explode("tags").alias("item"))
    targets = reassignments(out_docs, line, key, items, tops).groupBy(line).agg(F.count("*").alias("_moves"))
    each = [
        row(pairs.withColumnRenamed("a", line), "merge", F.col("confidence"), "high", F.col("risk"), other="b"),
        row(titles, "merge", sure(0.64 + F.least((F.col("_n") - 2) * 0.06, F.lit(0.12))), "high", "medium", detail="_n"),
        row(split, "split", sure(0.62 + F.col("fragmentation") * 0.25), "high", "high", detail="parts"),
        row(outlying.join(targets, line, "left"), "reassign", sure(0.5 + F.col("_share") * 0.6), "medium", "medium", detail="_moves"),
        row(found.where(F.col("noise") >= NOISE), "normalise", sure(0.52 + F.col("noise") * 0.5), "medium", "low"),
    ]
    out = reduce(DataFrame.unionByName, each)
    return out.orderBy(F.desc("confidence"), "action", line, F.col("other").asc_nulls_last()).limit(most) if most else out
