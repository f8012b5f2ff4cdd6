"""Lookups, semi- and anti-joins, interval overlap, reconciliation, similarity joins with blocking, set comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.sources.tables import checkpointed


def point_lookup(df: DataFrame, key: str, value, defaults: dict) -> DataFrame:
    """The row of a key, with defaults for its nulls; one row of defaults if there is none."""
    one = df.sparkSession.range(1).select(F.lit(value).cast(df.schema[key].dataType).alias(key))
    names = [c for c in df.columns if c != key]
    return one.join(df.where(F.col(key) == value), key, "left").select(key, *[F.coalesce(c, F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in names])


def existing(ids: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Which of the ids ``df`` has."""
    return ids.join(df.select(key), key, "left_semi")


def missing(df: DataFrame, other: DataFrame, key: str, version: tuple[str, str] | None = None) -> DataFrame:
    """Rows of ``df`` whose key ``other`` lacks (in this version, if one is named)."""
    side = other.where(F.col(version[0]) == version[1]) if version else other
    return df.join(side.select(key), key, "left_anti")


def flag_existing(df: DataFrame, other: DataFrame, key: str, flag: str) -> DataFrame:
    """``df`` with a boolean that says whether ``other`` has the row's key."""
    keys = other.select(key).distinct().withColumn(flag, F.lit(True))
    return df.join(keys, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def all_words(columns: list[str], phrase: str, most: int = 5, longest: int = 40) -> Column:
    """Whether each of the first words of a phrase stands in one of the columns, case aside."""
    words = [w[:longest].lower() for w in phrase.split()][:most]
    either = lambda w: reduce(Column.__or__, [F.coalesce(F.contains(F.lower(c), F.lit(w)), F.lit(False)) for c in columns])
    return reduce(Column.__and__, [either(w) for w in words], F.lit(True))


def other_endpoint(edges: DataFrame, a: str, b: str, nodes: DataFrame, key: str) -> DataFrame:
    """For each edge and each of its ends that ``nodes`` has, the end (``focus``) and the other one (``other``)."""
    both = edges.select("*", F.explode(F.array(F.struct(F.col(a).alias("focus"), F.col(b).alias("other")), F.struct(F.col(b).alias("focus"), F.col(a).alias("other")))).alias("_e"))
    return both.select(*edges.columns, "_e.focus", "_e.other").join(nodes.select(F.col(key).alias("focus")).distinct(), "focus", "left_semi")


def resolve_numbers(refs: DataFrame, ref_number: str, ref_year: str, docs: DataFrame, key: str, number: str, year: str) -> DataFrame:
    """``refs`` with the document of the same year whose number is the reference's, or else contains it; equal numbers first, then the smallest id.

    Each different reference is looked up once. Numbers stand in the index with all of their parts, a few dozen each, so
    both kinds are found by equality joins.
    """
    asked = refs.select(F.col(ref_number).alias("_rn"), F.col(ref_year).alias("_ry")).where("_rn IS NOT NULL AND _ry IS NOT NULL").distinct()
    d = docs.select(F.col(key).alias("_id"), F.col(number).cast("string").alias("_n"), F.col(year).alias("_y")).where("_n IS NOT NULL")
    size = F.length("_n")
    begins = F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda n: F.substring(F.col("_n"), i, n)))
    parts = d.where("_n <> ''").select("_y", "_id", (F.col("_n")).alias("_whole"), F.explode(F.array_distinct(F.flatten(begins))).alias("_part"))
    index = parts.groupBy("_y", "_part").agg(F.min(F.when(F.col("_part") == F.col("_whole"), F.col("_id"))).alias("_same"), F.min("_id").alias("_any"))
    found = asked.join(index, (F.col("_ry") == F.col("_y")) & (F.col("_rn") == F.col("_part"))).select("_rn", "_ry", F.coalesce("_same", "_any").alias("resolved"))
    return refs.join(found, (F.col(ref_number) == F.col("_rn")) & (F.col(ref_year) == F.col("_ry")), "left").drop("_rn", "_ry")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's place (from 1) in an order of all rows.

    From a range sort that is written, whose partitions' counts alone go to the driver; no window holds all rows.
    """
    sorted_ = checkpointed(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).cast("int")
    counts, before = {r["p"]: r["n"] for r in sorted_.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}, 0
    starts = []
    for p in sorted(counts):
        starts += [F.lit(p), F.lit(before)]
        before += counts[p]
    first = F.element_at(F.create_map(*(starts or [F.lit(0), F.lit(0)])), part)
    return sorted_.withColumn(name, (first + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).cast("long")).drop("_at")


def overlapping_ranges(a: DataFrame, b: DataFrame, width: int, start: str = "start", end: str = "end", a_id: str = "a_id", b_id: str = "b_id") -> DataFrame:
    """Pairs of ranges [start, end] that share a value.

    Both sides are laid out over cells of ``width`` values, so the join is an equality join whatever the number of
    ranges; a pair is reported in the first cell that both touch, hence once.
    """
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    left = a.select(F.col(a_id), F.col(start).alias("_s1"), F.col(end).alias("_e1"), F.explode(F.sequence(cell(start), cell(end))).alias("_cell"))
    right = b.select(F.col(b_id), F.col(start).alias("_s2"), F.col(end).alias("_e2"), F.explode(F.sequence(cell(start), cell(end))).alias("_cell"))
    first = F.floor(F.greatest("_s1", "_s2") / width).cast("long")
    return left.join(right, "_cell").where((F.col("_s1") <= F.col("_e2")) & (F.col("_e1") >= F.col("_s2")) & (F.col("_cell") == first)).select(a_id, b_id)


def reconcile(a: DataFrame, b: DataFrame, key: str, a_value: str, b_value: str) -> DataFrame:
    """Every key of two stores with what is wrong about it: only_left, only_right, differs or same."""
    left = a.select(key, F.col(a_value).alias("left_value"), F.lit(True).alias("_l"))
    right = b.select(key, F.col(b_value).alias("right_value"), F.lit(True).alias("_r"))
    status = F.when(F.col("_r").isNull(), "only_left").when(F.col("_l").isNull(), "only_right").when(F.col("left_value").eqNullSafe(F.col("right_value")), "same").otherwise("differs")
    return left.join(right, key, "full_outer").select(key, "left_value", "right_value", status.alias("status"))


def best_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in an order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def fuzzy_lookup(terms: DataFrame, term: str, vocabulary: DataFrame, word: str, prefix: int = 4, band: int = 3) -> DataFrame:
    """For each term the closest word of a vocabulary, or null.

    Compared are words with the same first letters and digits and a length within ``band``; a distance of 1 is close, 2 if
    the term is longer than 10. Ties go to the smaller word.
    """
    t = terms.select(F.col(term).alias("term")).distinct()
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    left = t.withColumn("_p", F.substring("term", 1, prefix)).withColumn("_d", digits("term"))
    right = vocabulary.select(F.col(word).alias("match")).distinct().withColumn("_p", F.substring("match", 1, prefix)).withColumn("_d", digits("match"))
    near = left.join(right, ["_p", "_d"]).where(F.abs(F.length("term") - F.length("match")) <= band)
    near = near.withColumn("distance", F.levenshtein("term", "match")).where(F.col("distance") <= F.when(F.length("term") > 10, 2).otherwise(1))
    best = near.groupBy("term").agg(F.min(F.struct("distance", "match")).alias("_b"))
    return t.join(best, "term", "left").select("term", F.col("_b.match").alias("match"), F.col("_b.distance").alias("distance"))


def sorted_neighbours(terms: DataFrame, term: str, window: int = 40) -> DataFrame:
    """Pairs of terms that stand less than ``window`` places apart in one lexical order of all, have the same digits and a small distance.

    The places come from a range sort, so no task holds all terms; the distance allowed is 1, 2 from 8 letters and 3 from 15.
    """
    placed = numbered(terms.select(F.col(term).alias("t")).where(F.col(term).isNotNull()).distinct(), [F.col("t")], "_r")
    # a window's neighbours lie in the own cell of `window` places or the next
    a = placed.select(F.col("t").alias("a"), F.col("_r").alias("_ra"), F.explode(F.array(F.floor(F.col("_r") / window), F.floor(F.col("_r") / window) + 1)).alias("_c"))
    b = placed.select(F.col("t").alias("b"), F.col("_r").alias("_rb"), F.floor(F.col("_r") / window).alias("_c"))
    gap = F.col("_rb") - F.col("_ra")
    allowed = F.when(F.least(F.length("a"), F.length("b")) >= 15, 3).when(F.least(F.length("a"), F.length("b")) >= 8, 2).otherwise(1)
    pairs = a.join(b, "_c").where((gap >= 1) & (gap < window) & (F.regexp_replace("a", r"\D", "") == F.regexp_replace("b", r"\D", "")))
    return pairs.withColumn("distance", F.levenshtein("a", "b")).where(F.col("distance") <= allowed).select("a", "b", "distance")


def similar_by_length(terms: DataFrame, term: str, least: int = 4, band: int = 3) -> DataFrame:
    """All pairs of terms of at least ``least`` letters, the shorter first, whose lengths differ by up to ``band`` and whose distance is small.

    The distance allowed is 1, 2 if the shorter term is longer than 8 and 3 if longer than 15. A term cut into one piece
    more than that has a piece that the other holds too, moved by no more than that, so pairs meet in an equality join.
    """
    t = terms.select(F.col(term).alias("t")).where(F.length(term) >= least).distinct()
    allowed = lambda n: F.when(n > 15, 3).when(n > 8, 2).otherwise(1)
    start = lambda n, i: F.floor(i * n / (allowed(n) + 1)).cast("int")
    size = F.col("_n")
    a = t.select(F.col("t").alias("a"), F.length("t").alias("_n")).withColumn("_i", F.explode(F.sequence(F.lit(0), allowed(size))))
    at, end = start(size, F.col("_i")), start(size, F.col("_i") + 1)
    a = a.select("a", "_n", "_i", F.substring("a", at + 1, end - at).alias("_piece"))
    b = t.select(F.col("t").alias("b"), F.explode(F.sequence(F.greatest(F.length("t") - band, F.lit(least)), F.length("t"))).alias("_n"))
    b = b.withColumn("_i", F.explode(F.sequence(F.lit(0), allowed(size)))).withColumn("_shift", F.explode(F.sequence(-allowed(size), allowed(size))))
    b = b.withColumn("_at", at + F.col("_shift")).where((F.col("_at") >= 0) & (F.col("_at") + end - at <= F.length("b")))
    b = b.select("b", "_n", "_i", F.substring("b", F.col("_at") + 1, end - at).alias("_piece")).distinct()
    met = a.join(b, ["_n", "_i", "_piece"]).where((F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))).select("a", "b").distinct()
    return met.withColumn("distance", F.levenshtein("a", "b")).where(F.col("distance") <= allowed(F.length("a")))


def temporal_pairs(df: DataFrame, group: str, key: str, ts: str, edges: DataFrame) -> DataFrame:
    """All pairs (earlier, later) of a group's rows, by time and then key, that aren't edges yet; rows without group or time are in none."""
    rows = df.where(F.col(group).isNotNull() & F.col(ts).isNotNull())
    a, b = (rows.select(group, F.col(key).alias(x), F.col(ts).alias(f"_{x}")) for x in ("src", "dst"))
    later = (F.col("_src") < F.col("_dst")) | ((F.col("_src") == F.col("_dst")) & (F.col("src") < F.col("dst")))
    return a.join(b, group).where(later).select(group, "src", "dst").join(edges.select("src", "dst"), ["src", "dst"], "left_anti")


def set_coefficients(sets: DataFrame, key: str, item: str, pairs: DataFrame) -> DataFrame:
    """For pairs (a, b) of keys the size of the intersection of their items, Jaccard and overlap coefficient (4 digits)."""
    s = sets.select(key, item).distinct()
    size = s.groupBy(key).agg(F.count("*").alias("_n"))
    common = pairs.join(s.select(F.col(key).alias("a"), item), "a").join(s.select(F.col(key).alias("b"), item), ["b", item]).groupBy("a", "b").agg(F.count("*").alias("common"))
    out = pairs.distinct().join(common, ["a", "b"], "left").join(size.select(F.col(key).alias("a"), F.col("_n").alias("na")), "a", "left").join(size.select(F.col(key).alias("b"), F.col("_n").alias("nb")), "b", "left")
    c, na, nb = (F.coalesce(x, F.lit(0)) for x in ("common", "na", "nb"))
    safe = lambda x, y: F.when(y > 0, F.floor(x / y * 10000.0 + 0.5) / 10000.0).otherwise(0.0)
    return out.select("a", "b", c.alias("common"), safe(c, na + nb - c).alias("jaccard"), safe(c, F.least(na, nb)).alias("overlap"))


def keyset_page(df: DataFrame, key: str, after, n: int) -> DataFrame:
    """The next ``n`` rows by key after a cursor, each with the next cursor."""
    page = df.where(F.col(key) > after).orderBy(key).limit(n)
    return page.crossJoin(F.broadcast(page.agg(F.max(key).alias("next_cursor"))))


def offset_page(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of rows with the number of rows and pages."""
    total = df.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))
    return df.orderBy(*order).offset((page - 1) * size).limit(size).crossJoin(F.broadcast(total))


def first_wins(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of several sources; of rows with the same key the one of the first source stays."""
    tagged = [s.withColumn("_priority", F.lit(i)) for i, s in enumerate(sources)]
    return best_per_key(reduce(DataFrame.unionByName, tagged), keys, [F.col("_priority")]).drop("_priority")


def suggest(df: DataFrame, column: str, part: str, n: int = 10, least: int = 3) -> DataFrame:
    """Up to ``n`` different values that contain a string, in order; none if the string is shorter than ``least``."""
    hit = F.contains(F.lower(column), F.lit(part.lower())) if len(part) >= least else F.lit(False)
    return df.where(hit).select(F.col(column).alias("suggestion")).distinct().orderBy("suggestion").limit(n)
