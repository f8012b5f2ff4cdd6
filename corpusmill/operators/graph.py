"""One-hop relation graphs: effects of actions, neighbourhoods, communities, routes, states, missing relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import full_year, plain_number, reference_numbers, rows_of_cells, segments, tag_display, tag_norm
from corpusmill.operators.aggregates import half_up
from corpusmill.operators.joins import best_per_key, first_wins
from corpusmill.sources.tables import checkpointed, dealt

# What an action does to what it refers to; other actions adjust.
EFFECT = {
    "applied": "strengthens", "confirmed": "strengthens", "complemented": "develops", "clarified": "develops", "reactivated": "adjusts", "altered": "adjusts", "partly_reconsidered": "limits", "reconsidered": "displaces",
}
EFFECTS = ["strengthens", "develops", "adjusts", "limits", "displaces"]
ALIASES = {"applies": "applied", "aplicado": "applied", "confirms": "confirmed", "clarifies": "clarified", "complements": "complemented", "alters": "altered", "reconsiders": "reconsidered"}


def action(x: Column) -> Column:
    """An action in its usual spelling."""
    low = F.lower(F.trim(x))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in ALIASES.items() for v in kv]), low), low)


def effect(x: Column) -> Column:
    """The effect class of an action."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in EFFECT.items() for v in kv]), action(x)), F.lit("adjusts"))


def effect_histograms(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """For each node edges in and out by effect, as one row of ten counts."""
    both = edges.select(F.explode(F.array(F.struct(F.col(src).alias("node"), F.concat(F.lit("out_"), "effect").alias("kind")), F.struct(F.col(dst).alias("node"), F.concat(F.lit("in_"), "effect").alias("kind")))).alias("e")).select("e.*")
    kinds = [f"{d}_{e}" for d in ("in", "out") for e in EFFECTS]
    return both.groupBy("node").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


def neighbours(edges: DataFrame, nodes: DataFrame, key: str, focus: DataFrame) -> DataFrame:
    """Edges of some nodes in both directions, with the other node's attributes."""
    out = edges.join(focus.select(F.col(key).alias("src")), "src", "left_semi").select(F.col("src").alias("focus"), F.col("dst").alias(key), "action", F.lit("out").alias("direction"))
    in_ = edges.join(focus.select(F.col(key).alias("dst")), "dst", "left_semi").select(F.col("dst").alias("focus"), F.col("src").alias(key), "action", F.lit("in").alias("direction"))
    return out.unionByName(in_).join(nodes, key)


def communities(edges: DataFrame, seeds: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Each seed with itself and its different neighbours; of several edges to one neighbour an outgoing one counts first. ``parts``: into how many partitions rows are dealt."""
    own = seeds.select(F.col(key).alias("seed"), F.col(key).alias("member"), F.lit("seed").alias("role"), F.lit(0).alias("_p"))
    ends = edges.select("src", "dst")
    # an inner join stays above the dealing, a semi-join is moved below it
    named = lambda end: dealt(seeds.select(F.col(key).alias(end)), parts, end).distinct()
    out = dealt(ends, parts, "src").join(named("src"), "src").select(F.col("src").alias("seed"), F.col("dst").alias("member"), F.lit("cited").alias("role"), F.lit(1).alias("_p"))
    in_ = dealt(ends, parts, "dst").join(named("dst"), "dst").select(F.col("dst").alias("seed"), F.col("src").alias("member"), F.lit("citing").alias("role"), F.lit(2).alias("_p"))
    return best_per_key(dealt(own.unionByName(out).unionByName(in_), parts, "seed", "member"), ["seed", "member"], [F.col("_p")]).drop("_p")


def inside_family(edges: DataFrame, keys: DataFrame, key: str, limit: int, order: list[Column]) -> DataFrame:
    """Edges that touch a set of nodes, with whether both ends are in it."""
    k = keys.select(F.col(key).alias("_k")).distinct().withColumn("_in", F.lit(True))
    a = edges.join(k.select(F.col("_k").alias("src"), F.col("_in").alias("_a")), "src", "left").join(k.select(F.col("_k").alias("dst"), F.col("_in").alias("_b")), "dst", "left")
    return a.where("_a OR _b").withColumn("inside_family", F.coalesce(F.col("_a") & F.col("_b"), F.lit(False))).drop("_a", "_b").orderBy(*order).limit(limit)


def regime(members: DataFrame, by: str) -> DataFrame:
    """State and scores of each community from its members' effects: displaced, contested, in transition, stable or forming."""
    s = members.groupBy(by).agg(F.count("*").alias("members"), F.count_if(F.col("effect") == "displaces").alias("displacing"), F.count_if(F.col("effect").isin("limits", "displaces")).alias("limiting"), F.count_if(F.col("effect") == "strengthens").alias("strengthening"))
    share = F.col("limiting") / F.col("members")
    state = F.when(F.col("displacing") > F.col("strengthening"), "displaced").when(share > 0.3, "contested").when(F.col("limiting") > 0, "in_transition").when(F.col("members") >= 3, "stable").otherwise("forming")
    stability = half_up(F.greatest(F.lit(0.0), 1 - share * 2), 3)
    coverage = half_up(F.least(F.lit(1.0), F.col("members") / 27000), 5)
    confidence = half_up(F.least(F.lit(1.0), stability * 0.7 + F.least(F.lit(0.3), F.col("members") * 0.05) + 0.1), 3)
    return s.select(by, "members", "displacing", "limiting", "strengthening", state.alias("state"), stability.alias("stability"), coverage.alias("coverage"), confidence.alias("confidence"))


def timeline(members: DataFrame, by: str, key: str, ts: str) -> DataFrame:
    """Events of each community: founded (first member), consolidated or displaced (last such effect), tension (first limiting one)."""
    order = F.struct(F.col(ts), F.col(key))
    pick = lambda name, cond, f: members.where(cond).groupBy(by).agg(f(F.struct(F.col(ts).alias("ts"), F.col(key).alias("k")), order).alias("x")).select(by, F.lit(name).alias("event"), F.col("x.k").alias(key), F.col("x.ts").alias(ts))
    everyone = F.lit(True)
    parts = [pick("founded", everyone, F.min_by), pick("consolidated", F.col("effect") == "strengthens", F.max_by), pick("displaced", F.col("effect") == "displaces", F.max_by), pick("tension", F.col("effect") == "limits", F.min_by)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def route(events: DataFrame, by: str, ts: str, key: str) -> DataFrame:
    """Events of a node in order with a running count of effects against it and what it is then: current, qualified or displaced."""
    w = Window.partitionBy(by).orderBy(ts, key)
    against, displaced = F.count_if(F.col("effect").isin("limits", "displaces")).over(w), F.max(F.when(F.col("effect") == "displaces", 1).otherwise(0)).over(w)
    return events.withColumn("step", F.row_number().over(w)).withColumn("against", against).withColumn("status", F.when(displaced == 1, "displaced").when(F.col("against") > 0, "qualified").otherwise("current"))


def retro_flags(edges: DataFrame, dst: str = "dst") -> DataFrame:
    """What a node's incoming actions make it: a sorted list of them."""
    return edges.groupBy(dst).agg(F.array_sort(F.collect_set(action(F.col("action")))).alias("flags"))


def missing_relations(pairs: DataFrame, words: DataFrame, sources: DataFrame, key: str, least: float = 0.3) -> DataFrame:
    """Proposals among pairs (src, dst): Jaccard of words (.6) and of sources (.4), with what kind of relation that suggests."""

    def jaccard(side: DataFrame, item: str, name: str) -> DataFrame:
        s = side.select(key, item).distinct()
        n = s.groupBy(key).agg(F.count("*").alias("n"))
        common = pairs.join(s.withColumnRenamed(key, "src"), "src").join(s.withColumnRenamed(key, "dst"), ["dst", item]).groupBy("src", "dst").agg(F.count("*").alias("c"))
        joined = common.join(n.select(F.col(key).alias("src"), F.col("n").alias("n1")), "src").join(n.select(F.col(key).alias("dst"), F.col("n").alias("n2")), "dst")
        return joined.select("src", "dst", (F.col("c") / (F.col("n1") + F.col("n2") - F.col("c"))).alias(name))

    out = pairs.join(jaccard(words, "word", "w"), ["src", "dst"], "left").join(jaccard(sources, "source", "s"), ["src", "dst"], "left").fillna(0.0, ["w", "s"])
    confidence = half_up(F.col("w") * 0.6 + F.col("s") * 0.4, 3)
    kind = F.when(F.col("s") >= 0.5, "applied").when(F.col("w") >= 0.5, "complemented").otherwise("clarified")
    return out.select("src", "dst", confidence.alias("confidence"), kind.alias("kind")).where(F.col("confidence") >= least)


def mined_relations(docs: DataFrame, key: str, text: str, verbs: dict[str, str]) -> DataFrame:
    """(src, action, number, year) for each verb that stands before a reference in a text."""
    refs = lambda v: F.regexp_extract_all(F.col(text), F.lit(rf"(?i)\b{v}\b[^.\n]{{0,40}}?(\d[\d.]*/\d{{2,4}})"), F.lit(1))
    named = lambda a: lambda r: F.struct(F.lit(a).alias("action"), r.alias("ref"))
    found = [F.transform(refs(v), named(a)) for v, a in verbs.items()]
    e = docs.select(F.col(key).alias("src"), F.explode(F.array_distinct(F.concat(*found))).alias("e"))
    return e.select("src", "e.action", F.regexp_replace(F.split_part("e.ref", F.lit("/"), F.lit(1)), r"\.", "").alias("number"), F.split_part("e.ref", F.lit("/"), F.lit(2)).alias("year"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``root``: the least node of each connected component of a graph, for every node of an edge.

    Stars are contracted in turn: each node sends its larger neighbours, then its smaller ones, to the least of them. The
    number of rounds grows with the logarithm of the graph and not with its longest path. After each round the edges are
    written; they never outnumber those given. Nodes are of any type that has an order.
    """
    e = checkpointed(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    both = lambda e: e.select("u", "v").union(e.select("v", "u"))
    least = lambda e: e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    before = None
    while True:
        near = both(e)
        large = near.join(least(near), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().where("u <> v")
        large = checkpointed(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        met = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = met.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        e = checkpointed(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if now == before:
            break
        before = now
    # all that is left are stars
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    alone = edges.where(F.col(a) == F.col(b)).select(F.col(a).alias("node"), F.col(b).alias("root")).distinct()
    known = e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
    return known.unionByName(alone.join(known, "node", "left_anti").select("node", "root"))


def representatives(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of similarity pairs of strings: each string with its component's shortest, then smallest, string."""
    rank = lambda c: F.struct(F.length(c).alias("n"), F.col(c).alias("s"))
    found = components(pairs.select(rank(a).alias("a"), rank(b).alias("b")), "a", "b")
    return found.select(F.col("node.s").alias("term"), F.col("root.s").alias("canonical"))


def rewritten_terms(catalog: DataFrame, id_: str, term: str, links: DataFrame, doc: str, link: str, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalog, links) after similar terms became one: what a rewrite of both tables leaves.

    ``pairs`` (a, b) says which normalised terms (``tag_norm``) are one. Of a cluster's rows the shortest term's stays, then
    the smallest id's, shown in the display form of the cluster's shortest normalised term; a term in no pair keeps its rows'
    first and takes the display form too. Links to rows that went point to the one that stays, and links that
    become equal are one. Rows whose term is empty, and links to rows that aren't there, stay as they are.
    """
    base = catalog.withColumn("_norm", tag_norm(F.col(term)))
    known = representatives(pairs, "a", "b").withColumnRenamed("term", "_norm").withColumnRenamed("canonical", "_root")
    rows = base.join(known, "_norm", "left").withColumn("_root", F.coalesce("_root", "_norm"))
    real = F.coalesce(F.col("_norm") != "", F.lit(False))
    master = rows.where(real).groupBy("_root").agg(F.min(F.struct(F.length(term), F.col(id_))).alias("_m")).select("_root", F.col(f"_m.{id_}").alias("_master"))
    marked = rows.where(real).join(master, "_root")
    after = marked.where(F.col(id_) == F.col("_master")).withColumn(term, tag_display(F.col("_root"))).select(catalog.columns)
    moved = marked.where(F.col(id_) != F.col("_master")).select(F.col(id_).alias("_from"), F.col("_master").alias("_to"))
    repointed = links.join(moved, F.col(link) == F.col("_from"), "left").select(doc, F.coalesce("_to", link).alias(link)).distinct()
    return after.unionByName(rows.where(~real).select(catalog.columns)), repointed


def candidate_relations(docs: DataFrame, key: str, html: str, text: str, refs: str, verbs: dict[str, str]) -> DataFrame:
    """(key, action, number, year, channel): what a document's action table, its action text and its list of references say of other documents.

    A table row has action, number and year; a text is cut before each verb, and each piece's references take its action;
    the list (structs of name and year) takes the action of a text of one piece. Of equal relations the earlier channel's stays.
    """
    acts = F.create_map(*[F.lit(v) for kv in verbs.items() for v in kv])
    pattern = "|".join(verbs)
    named = lambda x: F.try_element_at(acts, F.lower(F.regexp_extract(x, rf"(?i)^\s*({pattern})\b", 1)))
    relation = lambda action, number, year: F.struct(action.alias("action"), number.alias("number"), year.alias("year"))
    rows = F.filter(rows_of_cells(F.col(html)), lambda r: F.size(r) >= 3)
    from_rows = F.transform(rows, lambda r: relation(named(r[0]), plain_number(F.regexp_extract(r[1], r"(E?\d[\d.]*)", 1)), full_year(F.regexp_extract(r[2], r"(\d{4}|\d{2})", 1))))
    pieces = segments(F.col(text), pattern)
    from_text = F.flatten(F.transform(pieces, lambda p: F.transform(reference_numbers(p), lambda x: relation(named(p), x["number"], x["year"]))))
    from_refs = F.when(F.size(pieces) == 1, F.transform(refs, lambda x: relation(named(pieces[0]), plain_number(F.regexp_replace(x["name"], "(?i)N$", "")), full_year(x["year"]))))
    each = []
    for channel, found in (("table", from_rows), ("text", from_text), ("references", from_refs)):
        e = docs.select(key, F.explode(found).alias("e")).select(key, "e.*", F.lit(channel).alias("channel"))
        each.append(e.where("action IS NOT NULL AND number <> '' AND year IS NOT NULL"))
    return first_wins(each, [key, "action", "number", "year"])


def resolved_edges(refs: DataFrame, docs: DataFrame, key: str, number: str, year: str, composed: Column) -> tuple[DataFrame, DataFrame]:
    """(edges, orphans): references (number, year) with the document they mean, and those that mean none; ``composed`` marks numbers made of parts."""
    d = docs.groupBy(F.col(number).alias("number"), F.col(year).alias("year")).agg(F.min(key).alias("dst"))
    out = refs.join(d, ["number", "year"], "left").withColumn("orphan", F.col("dst").isNull()).withColumn("composed", composed)
    return out.where("NOT orphan"), out.where("orphan")
