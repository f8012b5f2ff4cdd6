"""Substring dedup: runs of ``window`` words that start in an earlier document are found and cut out.

Documents are cut into overlapping passages by minimisers: consecutive windows that share the smallest hash of a
word run inside them (their anchor) form one passage, so equal windows always meet under one anchor. Anchors seen in
one document only can hold no repeat and go. Of the others each different passage is kept once, with the smallest
id of its documents, and passages are dealt to shards by anchor. The passages of an anchor are numbered in the order of
these ids; for each bit of the number the shard builds a compressed FM-index (wavelet tree over the BWT) over the
passages with a zero there, and streams those with a one through it: backward search follows their matching statistics,
and the places where these reach ``window`` words are the repeats, with the smallest document that the index has of them.
Two passages differ in some bit, so each meets all earlier ones, in as many indexes as the number has bits.
An anchor with very many different passages is dealt by single windows, so no shard depends on one anchor's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import Powers, Words, encoded, gram_hashes, keyed, run_hashes, steps, tidy, written
from corpusmill.llm.fm_index import FMIndex

#: Words in the run whose smallest hash is a window's anchor.
ANCHOR_WORDS = 10
#: Different passages of one anchor beyond which its windows are dealt one by one.
HOT_PASSAGES = 1000
#: Words of the passages in one FM-index.
SHARD_WORDS = 250_000

_P1, _P2, _P3 = Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642F), Powers(0xE7037ED1A0B428DB)


def _passages(words: Words, window: int) -> tuple[np.ndarray, ...]:
    """Text number, start (in its words), windows and anchor of each passage, with two hashes of its words."""
    n = len(words) - window + 1
    gram = min(ANCHOR_WORDS, window)
    if n <= 0:
        return (np.zeros(0, dtype=np.int64),) * 6
    least = gram_hashes(words.hash, gram, _P1)
    span, reach = window - gram + 1, 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    least = least[:n]
    inside = words.text[:n] == words.text[window - 1 :]
    new = np.ones(n, dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    # where a text repeats itself one anchor goes on and on; its passages end after ``span`` windows all the same
    run_start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    new |= (np.arange(n) - run_start) % span == 0
    begin = np.flatnonzero(new & inside)
    count = np.bincount(np.cumsum(new & inside)[inside] - 1, minlength=len(begin))
    end = begin + count + window - 1
    text = words.text[begin]
    return text, begin - words.first[text], count, least[begin].view(np.int64), run_hashes(words.hash, begin, end, _P2).view(np.int64), run_hashes(words.hash, begin, end, _P3).view(np.int64)


def _cut(window: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = encoded(pdf["_text"])
            ids, keys = pdf["_id"].to_numpy(), pdf["_key"].to_numpy()
            for a, b in steps(texts):
                text, start, count, anchor, h1, h2 = _passages(Words(texts[a:b]), window)
                yield pd.DataFrame({"anchor": anchor, "h1": h1, "h2": h2, "n": count.astype(np.int32), "_id": ids[a:b][text], "_key": keys[a:b][text], "at": start.astype(np.int32)})

    return cut


def _texts(window: int):
    """Of each document's listed passages the words; of those of hot anchors each window by itself."""

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for doc, text, places in zip(pdf["_id"], encoded(pdf["_text"]), pdf["places"]):
                words = text.split()
                for p in places:
                    at, n = p["at"], p["n"]
                    if not p["hot"]:
                        out.append((p["anchor"], p["h1"], p["h2"], -1, p["anchor"], p["h1"], p["h2"], doc, b" ".join(words[at : at + n + window - 1])))
                        continue
                    for i in range(n):
                        piece = b" ".join(words[at + i : at + i + window])
                        d = np.frombuffer(hashlib.blake2b(piece, digest_size=24).digest(), dtype=np.int64)
                        out.append((p["anchor"], p["h1"], p["h2"], i, int(d[0]), int(d[1]), int(d[2]), doc, piece))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=_PIECE)
                    out = []
            yield pd.DataFrame(out, columns=_PIECE)

    return texts


_PIECE = ["anchor", "h1", "h2", "i", "shard", "p1", "p2", "doc", "words"]
_PIECE_TYPE = "anchor long, h1 long, h2 long, i int, shard long, p1 long, p2 long, doc long, words binary"


def first_owners(shard: np.ndarray, docs: np.ndarray, passages: list[list[bytes]], window: int) -> list[np.ndarray]:
    """For each start of ``window`` words in each passage, the smallest document of its shard key that has them.

    Rows come sorted by shard key and document. Each passage is streamed through one index for each one-bit of its number.
    """
    new = np.concatenate(([True], shard[1:] != shard[:-1]))
    start = np.maximum.accumulate(np.where(new, np.arange(len(shard)), 0))
    number = np.arange(len(shard)) - start
    many = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
    first = [np.full(len(p) - window + 1, d) for p, d in zip(passages, docs)]
    for bit in range(int(number.max(initial=0)).bit_length()):
        held = np.flatnonzero((number >> bit & 1 == 0) & (many > 1 << bit))
        index = FMIndex([passages[i] for i in held], docs[held], window)
        streamed = np.flatnonzero(number >> bit & 1)
        _, owners = index.matching_statistics([index.symbols(passages[i]) for i in streamed], least=window)
        for i, owner in zip(streamed, owners):
            first[i] = np.minimum(first[i], owner[: len(first[i])])
    return first


def _index(window: int):
    """FM-indexes over a partition's passages, which come sorted by shard key and document; a key's passages are never split."""

    def searched(rows: pd.DataFrame) -> pd.DataFrame:
        words = [w.split() for w in rows["words"]]
        return rows[["shard", "p1", "p2"]].assign(first=first_owners(rows["shard"].to_numpy(), rows["doc"].to_numpy(dtype=np.int64), words, window))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for pdf in batches:
            weight = pdf["words"].map(len).to_numpy().cumsum() // 6
            cuts, base = [0], 0
            shard = pdf["shard"].to_numpy()
            for i in np.flatnonzero(np.concatenate(([not held or held[-1]["shard"].iloc[-1] != shard[0]], shard[1:] != shard[:-1]))):
                before = int(weight[i - 1]) if i else 0
                if size + before - base >= SHARD_WORDS:
                    cuts.append(int(i))
                    base, size = before, 0
            for a, b in zip(cuts, [*cuts[1:], None]):
                held.append(pdf.iloc[a:b])
                if b is not None:
                    yield searched(pd.concat(held, ignore_index=True))
                    held = []
            size += int(weight[-1]) - base if len(weight) else 0
        if any(len(h) for h in held):
            yield searched(pd.concat(held, ignore_index=True))

    return index


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """``_id``, ``_key`` and ``spans``: array of (at, n), word ranges covered by windows that start in a document with a smaller id.

    Rows without id take no part (no order says what is earlier); null and short texts have no windows. Rows with the
    same id never repeat each other.
    """
    rows = keyed(docs, id_col, text_col).where(F.col("_id").isNotNull())
    cut = rows.mapInPandas(tidy(_cut(window)), "anchor long, h1 long, h2 long, n int, _id long, _key long, at int")
    # written, so that the join with it is free to split an anchor that very many documents have
    shared = written(cut.groupBy("anchor").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi")).where("lo < hi").select("anchor"), "anchors")
    held = written(cut.join(shared, "anchor"), "passages")
    different = held.groupBy("anchor", "h1", "h2", "n").agg(F.min(F.struct("_id", "_key", "at")).alias("o"))
    hot = held.groupBy("anchor", "h1", "h2").agg(F.lit(1).alias("one")).groupBy("anchor").agg(F.count("*").alias("many")).where(F.col("many") > HOT_PASSAGES).select("anchor", F.lit(True).alias("hot"))
    places = different.join(hot, "anchor", "left").select(F.col("o._id").alias("_id"), F.col("o._key").alias("_key"), F.struct("anchor", "h1", "h2", "n", "o.at", F.coalesce("hot", F.lit(False)).alias("hot")).alias("p"))
    places = places.groupBy("_id", "_key").agg(F.collect_list("p").alias("places"))
    once = rows.join(places, ["_id", "_key"]).select("_id", "_text", "places")
    pieces = written(once.mapInPandas(tidy(_texts(window)), _PIECE_TYPE), "pieces")
    unique = pieces.groupBy("shard", "p1", "p2").agg(F.min("doc").alias("doc"), F.min("words").alias("words"))
    found = unique.repartition("shard").sortWithinPartitions("shard", "doc").mapInPandas(tidy(_index(window)), "shard long, p1 long, p2 long, first array<long>")
    found = pieces.select("anchor", "h1", "h2", "i", "shard", "p1", "p2").join(found, ["shard", "p1", "p2"])
    # the windows of hot passages come one by one, at most as many as a passage has; i is -1 for a whole passage
    found = found.groupBy("anchor", "h1", "h2").agg(F.flatten(F.transform(F.array_sort(F.collect_set(F.struct("i", "first"))), lambda x: x["first"])).alias("first"))
    whole = held.join(found, ["anchor", "h1", "h2"])
    hits = whole.select("_id", "_key", "at", F.transform("first", lambda d: d < F.col("_id")).alias("hit")).where(F.exists("hit", lambda x: x))
    spans = hits.select("_id", "_key", F.explode(_runs(F.col("hit"), F.col("at"), window)).alias("s"))
    return spans.groupBy("_id", "_key").agg(F.collect_set("s").alias("spans"))


def _runs(hit, at, window: int):
    """(at, n) of each run of true values, as the words that its windows cover."""
    none = F.array().cast("array<struct<at:int,n:int>>")
    one = lambda i: F.array(F.struct((at + i).cast("int").alias("at"), F.lit(window).alias("n")))

    def add(done, x):
        i, flag = x["i"], x["hit"]
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["at"].alias("at"), (last["n"] + 1).cast("int").alias("n"))))
        extends = (F.size(done) > 0) & (last["at"] + last["n"] == at + i + window - 1)
        return F.when(~flag, done).when(extends, joined).otherwise(F.concat(done, one(i)))

    return F.aggregate(F.transform(hit, lambda h, i: F.struct(h.alias("hit"), i.alias("i"))), none, add)


def _removed(columns: list[str]):
    def removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text, spans in zip(pdf["_id"], encoded(pdf["_text"]), pdf["spans"]):
                words = text.split()
                n, gone = len(words), 0
                if spans is not None and len(spans):
                    keep = np.ones(n, dtype=bool)
                    for s in spans:
                        keep[s["at"] : s["at"] + s["n"]] = False
                    gone = int(n - keep.sum())
                    words = [w for w, k in zip(words, keep) if k]
                kept = b" ".join(words)
                out.append((doc, n, gone, kept.decode("utf-8", "replace") if "kept_text" in columns else None, hashlib.sha256(kept).hexdigest()))
            frame = pd.DataFrame(out, columns=["_id", "n_words", "n_removed", "kept_text", "kept_sha256"])
            frame["_id"] = frame["_id"].astype("Int64")
            yield frame[columns]

    return removed


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, with_text: bool = True) -> DataFrame:
    """Each row's id, words, removed words, what is left (words joined by one space) and its SHA-256.

    One row for each input row. Null texts have no words; a null id keeps its whole text.
    """
    rows = keyed(docs, id_col, text_col)
    columns = ["_id", "n_words", "n_removed", *["kept_text"] * with_text, "kept_sha256"]
    kind = {"_id": "long", "n_words": "long", "n_removed": "long", "kept_text": "string", "kept_sha256": "string"}
    joined = rows.join(repeated_windows(docs, id_col, text_col, window), ["_id", "_key"], "left").select("_id", "_text", "spans")
    out = joined.mapInPandas(tidy(_removed(columns)), ", ".join(f"{c} {kind[c]}" for c in columns))
    return out.withColumnRenamed("_id", id_col)
