"""Quality rules: repetition counts, and tokeniser fertility with rejection bands per language.

A text that a public vocabulary cuts into unusually many tokens a word or characters a token, that falls back to bytes
unusually often, or whose tokens have an unusual entropy isn't ordinary prose of its language. Bands come from the corpus
itself: quartiles of each figure over all rows of a language and size class (powers of two of words) that pass the base
rules, to the thousandth and exact, widened by a multiple of their distance. A class with too few rows takes in the next sizes of its language; a
language with too few rows has the bands of its script, and that of the corpus after it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import Powers, Words, encoded, gram_hashes, steps, tidy, written

_SYMBOL = str.maketrans("", "", "#*$%&|<>")
_GRAM = Powers(0xC2B2AE3D27D4EB4F)
_LINE_WORD = re.compile("[^\x20\x09-\x0d]")
#: Words of a window whose return counts as repetition.
WINDOW = 5
#: What a figure may lie beyond its band, and the largest value of a figure (of tokens a word, in texts that hardly have words).
SLACK, MOST = 0.01, 1000.0
#: First code points of runs of scripts; a text's script is the run that most of its characters beyond ASCII's signs lie in.
SCRIPTS = np.array([0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x2E80, 0x3040, 0x3100, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0x1F000, 0x20000], dtype=np.uint32)
FIGURES = ("chars_per_token", "tokens_per_word", "byte_share", "entropy")


@lru_cache(maxsize=2)
def vocabulary(model_file: str) -> tuple[sentencepiece.SentencePieceProcessor, np.ndarray]:
    """The public tokeniser and, for each id, whether it is a byte beyond ASCII."""
    tool = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return tool, np.asarray([tool.is_byte(i) and int(tool.id_to_piece(i)[3:-1], 16) >= 128 for i in range(tool.get_piece_size())])


def repeated_words(words: Words, window: int = WINDOW) -> np.ndarray:
    """Of each text, the words inside a window of ``window`` words that stands in the text twice or more."""
    grams = gram_hashes(words.hash, window, _GRAM)
    inside = np.flatnonzero(words.text[: len(grams)] == words.text[len(words) - len(grams) :])
    text, value = words.text[inside], grams[inside]
    order = np.lexsort((value, text))
    same = (text[order][1:] == text[order][:-1]) & (value[order][1:] == value[order][:-1])
    again = np.zeros(len(order), dtype=bool)
    again[:-1] |= same
    again[1:] |= same
    edge = np.zeros(len(words) + window + 1, dtype=np.int64)
    at = inside[order[again]]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    covered = np.cumsum(edge)[: len(words)] > 0
    return np.bincount(words.text[covered], minlength=len(words.offset))


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if _LINE_WORD.search(line):
            n += line in seen
            seen.add(line)
    return n


def fertility(ids: list[int], text: str, words: int, byte_ids: np.ndarray) -> tuple[float, float, float, float]:
    """Characters a token, tokens a word, share of tokens that are bytes beyond ASCII, and entropy of the tokens in bits over that of as many different ones."""
    n = len(ids)
    if not n:
        return 0.0, 0.0, 0.0, 0.0
    count = np.bincount(ids, minlength=len(byte_ids))
    p = count[count > 0] / n
    return min(MOST, len(text) / n), min(MOST, n / max(1, words)), float(count[byte_ids].sum() / n), float(-(p * np.log2(p)).sum() / np.log2(n)) if n > 1 else 1.0


def script(text: str) -> int:
    """Which of SCRIPTS most letters of a text lie in; texts without any count as Latin."""
    if text.isascii():
        return 0
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    beyond = points[(points >= 0x80) | ((points | 32) - 97 < 26)]
    return int(np.bincount(np.searchsorted(SCRIPTS, beyond, side="right") - 1).argmax())


def figures(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", language: Column | None = None) -> DataFrame:
    """_id, _language, _script, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_tokens and FIGURES of each row's whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool, byte_ids = vocabulary(model_file)
        for pdf in batches:
            raw = encoded(pdf["_text"])
            for a, b in steps(raw):
                words = Words(raw[a:b])
                n_words, again = np.diff(words.first), repeated_words(words)
                out = []
                for i, data in enumerate(raw[a:b]):
                    text = data.decode("utf-8")
                    ids = tool.encode(text)
                    bare = b"".join(data.split()).decode("utf-8")
                    out.append((len(bare), len(text) - len(text.translate(_SYMBOL)), repeated_lines(text), len(ids), script(text), *fertility(ids, text, int(n_words[i]), byte_ids)))
                frame = pd.DataFrame(out, columns=["word_chars", "n_symbols", "n_dup_lines", "n_tokens", "_script", *FIGURES])
                frame.insert(0, "_id", pdf["_id"].iloc[a:b].astype("Int64").to_numpy())
                frame.insert(1, "_language", pdf["_language"].iloc[a:b].to_numpy())
                frame.insert(2, "n_words", n_words)
                frame["n_repeat_words"] = again
                frame["base_failed"] = (n_words < 10) | (100 * again > 20 * n_words)
                yield frame

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), (language if language is not None else F.lit(None)).cast("string").alias("_language"))
    kinds = "_id long, _language string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_tokens long, _script int, " + ", ".join(f"{x} double" for x in FIGURES) + ", n_repeat_words long, base_failed boolean"
    return rows.mapInPandas(tidy(run), kinds)


def counted(rows: DataFrame) -> DataFrame:
    """How many rows that pass the base rules have each value of each figure, by language, script and size class.

    Values are thousandths up to MOST, so there are as few of them however many rows there are.
    """
    each_figure = F.explode(F.array(*[F.struct(F.lit(x).alias("figure"), F.round(F.col(x), 3).alias("value")) for x in FIGURES]))
    good = rows.where("NOT base_failed").select("_language", "_script", "_class", each_figure.alias("f"))
    return good.groupBy("_language", "_script", "_class", "f.figure", "f.value").agg(F.count("*").alias("_n"))


def bands(values: DataFrame, asked: DataFrame, spread: float, least_rows: int, always: bool) -> DataFrame:
    """``_of``, ``_in`` and the lower and upper end of each figure for the groups and size classes in ``asked``.

    ``values`` are ``counted`` values of each group (``_group``). Quartiles are of all rows of the group whose size is no
    further from the class than it takes for ``least_rows``. A group that has fewer in all has none, or the quartiles of all
    its rows with ``always``.
    """
    sizes = values.where(F.col("figure") == FIGURES[0]).groupBy("_group", "_class").agg(F.sum("_n").alias("_n"))
    pairs = asked.join(sizes, F.col("_of").eqNullSafe(F.col("_group"))).select("_of", "_in", F.col("_class").alias("_from"), "_n", F.abs(F.col("_class") - F.col("_in")).alias("_far"))
    # a row for each two size classes of a group, whatever the corpus's size
    each = Window.partitionBy("_of", "_in")
    upto = pairs.withColumn("_rows", F.sum("_n").over(each.orderBy("_far")))
    reach = F.min(F.when(F.col("_rows") >= least_rows, F.col("_far"))).over(each)
    reach = F.coalesce(reach, F.max("_far").over(each)) if always else reach
    taken = upto.withColumn("_reach", reach).where("_far <= _reach").select("_of", "_in", "_from")
    members = values.join(taken, F.col("_of").eqNullSafe(F.col("_group")) & (F.col("_class") == F.col("_from")))
    one = lambda x, share: F.percentile(F.when(F.col("figure") == x, F.col("value")), share, F.col("_n"))
    quartiles = members.groupBy("_of", "_in").agg(*[F.array(one(x, 0.25), one(x, 0.75)).alias(x) for x in FIGURES])
    ends = []
    for x in FIGURES:
        low, high = F.col(x)[0], F.col(x)[1]
        ends += [(low - (high - low) * spread).alias(f"{x}_low"), (high + (high - low) * spread).alias(f"{x}_high")]
    return quartiles.select("_of", "_in", *ends)


def all_bands(rows: DataFrame, spread: float, least_rows: int = 50) -> DataFrame:
    """A band for each language, script and size class with a row that passes the base rules: by language, else by script, else by corpus."""
    values = written(counted(rows), "values")
    left = written(values.select(F.col("_language").alias("_l"), F.col("_script").alias("_s"), F.col("_class").alias("_c")).distinct(), "classes")
    out = []
    for label, group, own, always in (("language", F.col("_language"), F.col("_l"), False), ("script", F.col("_script"), F.col("_s"), False), ("corpus", F.lit(0), F.lit(0), True)):
        asked = left.select(own.alias("_of"), F.col("_c").alias("_in")).distinct()
        found = written(bands(values.withColumn("_group", group), asked, spread, least_rows, always), f"bands_{label}")
        same = own.eqNullSafe(F.col("_of")) & (F.col("_c") == F.col("_in"))
        out.append(left.join(found, same).drop("_of", "_in"))
        left = left.join(found, same, "left_anti")
    return reduce(DataFrame.unionByName, out)


def quality(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", language: Column | None = None, spread: float = 4.0) -> DataFrame:
    """Figures of each row with base_failed and kept.

    Kept is false if the base rules fail or a figure is outside the band of its language and size (``all_bands``); the byte
    share has an upper end only. A null text has no words and fails. Rows without a language form a group of their own. Bands have
    SLACK at both ends, so that a group of nearly equal rows rejects nothing that is nearly equal to them. Texts are judged
    whole, repeated rows each for itself and each counts in the bands; ties are no matter, since quartiles interpolate between
    values. Other columns of ``docs``, whatever their names, are left out.
    """
    rows = figures(docs, model_file, id_col, text_col, language).withColumn("_class", F.floor(F.log2(F.greatest("n_words", F.lit(1)))).cast("int"))
    rows = written(rows, "figures")
    ok = F.lit(True)
    for x in FIGURES:
        inside = F.col(x) <= F.col(f"{x}_high") + SLACK
        ok = ok & F.coalesce(inside if x == "byte_share" else inside & (F.col(x) >= F.col(f"{x}_low") - SLACK), F.lit(True))
    # one row for each language, script and size class, whatever the corpus's size
    same = F.col("_language").eqNullSafe(F.col("_l")) & (F.col("_script") == F.col("_s")) & (F.col("_class") == F.col("_c"))
    out = rows.join(written(all_bands(rows, spread), "bands"), same, "left")
    return out.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ok).alias("kept"), *FIGURES)
