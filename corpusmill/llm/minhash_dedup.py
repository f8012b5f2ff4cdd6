"""Near duplicates: fast similarity sketches, banding, exact verification, connected components.

Rows with the same set of shingles form a class, named by its smallest id. Classes are sketched; each band of the
sketch is a bucket. First every member of a bucket is compared with the bucket's smallest member only, which links the
bulk of any group in as many comparisons as it has members. Components that still share a bucket are compared member by
member on the full sets inside tasks, in blocks; only links that connect what isn't connected come out, so no group is
expanded into all its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import Powers, Words, encoded, gram_hashes, keyed, mix, run_hashes, steps, tidy, written
from corpusmill.llm.components import components

_GRAM, _RUN = Powers(0x8EBC6AF09C88C6E3), Powers(0x589965CC75374CC3)
_U64 = np.uint64
_EMPTY = _U64(0xFFFFFFFFFFFFFFFF)

#: Shingles in one block of a group's members.
BLOCK = 200_000


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and hashes of the distinct shingles of some texts, sorted by both.

    A-Z count as a-z. A text with fewer words than ``width`` has its whole sequence as one shingle; without words, none.
    """
    words = Words([t.lower() for t in texts])
    count = np.diff(words.first)
    grams = gram_hashes(words.hash, width, _GRAM)
    inside = words.text[: len(grams)] == words.text[len(words) - len(grams) :]
    short = np.flatnonzero((count > 0) & (count < width))
    whole = run_hashes(words.hash, words.first[:-1][short], words.first[1:][short], _RUN)
    text = np.concatenate((words.text[: len(grams)][inside], short))
    value = np.concatenate((grams[inside], whole))
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]


def sketches(text: np.ndarray, value: np.ndarray, many: int, size: int) -> np.ndarray:
    """Fast similarity sketches of ``many`` sets, ``size`` coordinates each.

    In round i < size each element goes to a random coordinate; a coordinate keeps the smallest value of the first
    round that reaches it. Round size + j sends all elements to coordinate j, so that every coordinate of a set that
    isn't empty is filled at last. A set leaves once its coordinates are full.
    """
    out = np.full(many * size, _EMPTY, dtype=_U64)
    low = _U64((1 << 52) - 1)
    round_, total = 0, 2 * size
    while len(text) and round_ < total:
        block = np.arange(round_, min(total, size if round_ < size else total, round_ + max(1, min(64, 400_000 // len(text)))), dtype=_U64)
        h = mix(value[None, :] ^ mix(block)[:, None])
        if round_ < size:
            place = ((h >> _U64(40)) * _U64(size) >> _U64(24)).astype(np.int64)
        else:
            place = np.broadcast_to((block - _U64(size)).astype(np.int64)[:, None], h.shape)
        held = (block << _U64(52))[:, None] | (mix(h) & low)
        np.minimum.at(out, (place + text[None, :] * size).ravel(), held.ravel())
        round_ += len(block)
        open_ = (out.reshape(many, size) == _EMPTY).any(axis=1)[text]
        text, value = text[open_], value[open_]
    return out.reshape(many, size)


def band_keys(sketch: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of each sketch; the band's number is part of it."""
    rows = sketch.reshape(len(sketch), bands, -1)
    key = np.broadcast_to(mix(np.arange(bands, dtype=_U64)), rows.shape[:2])
    with np.errstate(over="ignore"):
        for r in range(rows.shape[2]):
            key = mix(key ^ rows[:, :, r])
    return key.view(np.int64)


def _described(width: int, bands: int, rows: int):
    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, ids, keys = encoded(pdf["_text"]), pdf["_id"].to_numpy(), pdf["_key"].to_numpy()
            for a, b in steps(texts):
                text, value = shingle_sets(texts[a:b], width)
                n = np.bincount(text, minlength=b - a)
                edge = np.concatenate(([0], np.cumsum(n)))
                marks = [np.frombuffer(hashlib.blake2b(value[i:j].tobytes(), digest_size=16).digest(), dtype=np.int64) for i, j in zip(edge, edge[1:])]
                band = band_keys(sketches(text, value, b - a, bands * rows), bands)
                yield pd.DataFrame({"_id": ids[a:b], "_key": keys[a:b], "n": n, "s1": [m[0] for m in marks], "s2": [m[1] for m in marks], "bands": list(band)})

    return described


def _linked(width: int, percent: int):
    """Of each pair with both texts, whether the sets' similarity is at least ``percent`` in a hundred."""

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [encoded(pdf["ta"]), encoded(pdf["tb"])]
            a, b = pdf["a"].to_numpy(), pdf["b"].to_numpy()
            for i, j in steps(x + y for x, y in zip(*both)):
                # a text that many pairs share is cut into shingles once
                number: dict[bytes, int] = {}
                left = [number.setdefault(t, len(number)) for t in both[0][i:j]]
                right = [number.setdefault(t, len(number)) for t in both[1][i:j]]
                text, value = shingle_sets(list(number), width)
                edge = np.searchsorted(text, np.arange(len(number) + 1))
                sets = [value[x:y] for x, y in zip(edge, edge[1:])]
                keep = np.zeros(j - i, dtype=bool)
                for k, (x, y) in enumerate(zip(left, right)):
                    common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    keep[k] = common > 0 and 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common)
                yield pd.DataFrame({"a": a[i:j][keep], "b": b[i:j][keep]})

    return linked


def _sets(width: int):
    """The set of each row's text."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, ids = encoded(pdf["_text"]), pdf["_id"].to_numpy()
            for a, b in steps(texts):
                text, value = shingle_sets(texts[a:b], width)
                edge = np.searchsorted(text, np.arange(b - a + 1))
                yield pd.DataFrame({"_id": ids[a:b], "set": [value[i:j].tobytes() for i, j in zip(edge, edge[1:])]})

    return sets


def connecting(ids: np.ndarray, part: np.ndarray, out: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between outer rows (``out``) and the others of some block that are in different parts, leaving out those that earlier ones imply.

    Each outer set is marked and counted in all sets whose size allows a link, which stand side by side.
    """
    others = np.flatnonzero(~out)
    n = np.fromiter((len(s) for s in sets), dtype=np.int64, count=len(sets))
    others = others[np.argsort(n[others], kind="stable")]
    flat, place = np.unique(np.concatenate([sets[i] for i in others]), return_inverse=True)
    size = n[others]
    edge = np.concatenate(([0], np.cumsum(size)))
    top, marked, found = part.copy(), np.zeros(len(flat) + 1, dtype=bool), []
    for a in np.flatnonzero(out):
        low, high = np.searchsorted(size * 100, n[a] * percent), np.searchsorted(size * percent, n[a] * 100, side="right")
        if low >= high or (top[others[low:high]] == top[a]).all():
            continue
        at = np.searchsorted(flat, sets[a])
        at = at[flat[np.minimum(at, len(flat) - 1)] == sets[a]]
        marked[at] = True
        common = np.add.reduceat(marked[place[edge[low] : edge[high]]], edge[low:high] - edge[low], dtype=np.int64)
        marked[at] = False
        for b in others[low:high][100 * common >= percent * (size[low:high] + n[a] - common)]:
            if top[b] != top[a]:
                top[top == top[b]] = top[a]
                found.append((ids[a], ids[b]))
    return found


def _across(parts: DataFrame, near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components of a group: a main component and those (outer) that share a bucket with it.

    parts: _id, n, part of all members of buckets; near: (main, part) of each outer component; sets: _id, set.
    Outer members in blocks meet all members of their group in blocks; a task holds two blocks at a time and compares the
    full sets of every pair in them that isn't connected by then, so no more links come out than there are members.
    """
    place = lambda n, seed: F.pmod(F.xxhash64("_id", F.lit(seed)), F.col(n)).cast("int")
    outer = near.join(parts, "part").select(F.col("main").alias("group"), "_id", "n", "part", F.lit(True).alias("out"))
    inner = near.select("main").distinct().join(parts, F.col("main") == F.col("part")).select(F.col("main").alias("group"), "_id", "n", "part", F.lit(False).alias("out"))
    members = written(outer.unionByName(inner), "groups")
    blocks_of = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = members.groupBy("group").agg(blocks_of(F.sum(F.when(F.col("out"), F.col("n")))).alias("ni"), blocks_of(F.sum("n")).alias("nj"))
    rows = members.join(sizes, "group").join(sets, "_id")
    cols = ["group", "_id", "part", "set"]
    x = rows.where("out").select(*cols, F.lit(True).alias("out"), place("ni", 1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"))
    y = rows.select(*cols, F.lit(False).alias("out"), F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"), place("nj", 2).alias("j"))

    def compared(group: pd.DataFrame) -> pd.DataFrame | None:
        out = group["out"].to_numpy()
        if out.all() or not out.any():
            return None
        found = connecting(group["_id"].to_numpy(), group["part"].to_numpy(), out, [np.frombuffer(s, dtype=_U64) for s in group["set"]], percent)
        return pd.DataFrame(found, columns=["a", "b"]) if found else None

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            key = pdf[["group", "i", "j"]].to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1)))) if len(key) else []
            for a, b in zip(edge, [*edge[1:], len(pdf)]):
                if held and (held[-1][["group", "i", "j"]].iloc[-1].to_numpy() != key[a]).any():
                    if (out := compared(pd.concat(held) if len(held) > 1 else held[0])) is not None:
                        yield out
                    held = []
                held.append(pdf.iloc[a:b])
        if held and (out := compared(pd.concat(held))) is not None:
            yield out

    return x.unionByName(y).repartition("group", "i", "j").sortWithinPartitions("group", "i", "j").mapInPandas(tidy(blocks), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = 56, rows: int = 8) -> DataFrame:
    """Of each row: id, n_shingles, component_id (smallest id reachable over links) and kept (its id is the component's).

    Two texts are linked when their sets of ``width``-word shingles have a similarity of ``percent``/100 or more; each link
    is confirmed on the full sets. A pair of similarity s meets in a bucket with probability 1 - (1 - s^rows)^bands; of the
    components that meet, all pairs are compared. Null and empty texts are linked with nothing. A row with a null id is
    kept and has no component; rows with equal ids count as one node. Texts of any length are whole sets; other columns
    of ``docs``, whatever their names, are left out.
    """
    texts = keyed(docs, id_col, text_col)
    described = written(texts.mapInPandas(tidy(_described(width, bands, rows)), "_id long, _key long, n long, s1 long, s2 long, bands array<long>"), "described")
    named = described.where("_id IS NOT NULL AND n > 0")
    # written, so that joins with it are free to split a class of very many copies
    classes = written(named.groupBy("s1", "s2").agg(F.min("_id").alias("rep")), "classes")
    spread = named.join(classes, ["s1", "s2"]).where("_id = rep").select("_id", "n", F.explode("bands").alias("band"))
    full = spread.groupBy("band").agg(F.min(F.struct("_id", "n")).alias("low"), F.max("_id").alias("high")).where("low._id < high").select("band", "low")
    members = written(spread.join(full, "band"), "buckets")
    near = lambda x, y: (x * 100 >= y * percent) & (y * 100 >= x * percent)
    stars = members.where((F.col("_id") != F.col("low._id")) & near(F.col("n"), F.col("low.n"))).select(F.col("low._id").alias("a"), F.col("_id").alias("b")).distinct()
    wanted = members.select("_id").distinct()
    held = written(texts.join(wanted, "_id", "left_semi").dropDuplicates(["_id", "_key"]).select("_id", "_text"), "candidates")

    def verified(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(held.select(F.col("_id").alias("a"), F.col("_text").alias("ta")), "a")
        with_b = with_a.join(held.select(F.col("_id").alias("b"), F.col("_text").alias("tb")), "b")
        return with_b.select("a", "b", "ta", "tb").mapInPandas(tidy(_linked(width, percent)), "a long, b long")

    links = written(verified(stars), "links")
    parts = components(links)
    labelled = written(members.select("_id", "n").distinct().join(parts, F.col("_id") == F.col("id"), "left").select("_id", "n", F.coalesce("component", "_id").alias("part")), "labelled")
    # the largest component of those that share a bucket is the main one, so that the smaller ones are what moves
    whole = labelled.groupBy("part").agg(F.count("*").alias("many"))
    rest = members.select("band", "_id").join(labelled, "_id").select("band", "part").distinct().join(whole, "part")
    mains = rest.groupBy("band").agg(F.max(F.struct("many", "part")).alias("most"), F.count("*").alias("parts")).where("parts > 1").select("band", F.col("most.part").alias("main"))
    near_parts = written(rest.join(mains, "band").where("part != main").select("main", "part").distinct(), "near")
    wide = near_parts.select(F.explode(F.array("main", "part")).alias("part")).distinct().join(labelled, "part").select("_id")
    sets = held.join(wide, "_id", "left_semi").mapInPandas(tidy(_sets(width)), "_id long, set binary").dropDuplicates(["_id"])
    more = written(_across(labelled, near_parts, written(sets, "sets"), percent), "links")
    if not more.isEmpty():
        parts = components(links.union(more))
    found = described.select("_id", "n", "s1", "s2").join(classes, ["s1", "s2"], "left").join(parts, F.col("rep") == F.col("id"), "left")
    component = F.coalesce("component", "rep", "_id")
    return found.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("_id").isNull() | (F.col("_id") == component)).alias("kept"))
