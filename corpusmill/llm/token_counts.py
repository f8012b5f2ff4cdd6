"""Exact token counts of every prefix of a text, by dynamic programming over the prefix table of a public BPE vocabulary.

The counts up to the end of each stretch without white space are one array a text, and within a stretch the table has the
count of every prefix of its words. How much of a text fits a budget is then a search in the array and in the counts of the
one stretch that crosses the budget; nothing is encoded again.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import tidy
from corpusmill.llm.prefix_table import PrefixTable, Recent

#: Chunks, and words, in the young half of their cache.
CHUNKS = 120_000
_END = ""  # stands for the vocabulary's end-of-word mark, as one character
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Stretches that the library's rules leave as they are but for case: printable ASCII and Latin letters, composed.
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ɏ]+")
_CLUSTER = regex.compile(r"\X", regex.DOTALL)
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_BLANK = re.compile("[^\t-\r \x85\xa0  -     　]+")


class Counter:
    """Token counts as the library gives them for a lower-casing BPE vocabulary with word ends.

    White space separates: what stands between (a chunk) is normalised and cut into words by the library's own rules, and
    each word gets its prefix table. Special strings are one token each, wherever they stand.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        if model["type"] != "BPE" or not self.suffix or spec["pre_tokenizer"]["pretokenizers"][0]["behavior"] != "Removed":
            raise ValueError("a BPE vocabulary with word ends whose words exclude white space is needed")
        tool = Tokenizer.from_file(file)
        self.normalise, self.words = tool.normalizer.normalize_str, tool.pre_tokenizer.pre_tokenize_str
        ends = lambda s: s[: -len(self.suffix)] + _END if s.endswith(self.suffix) else s
        merges = [(ends(a), ends(b)) for a, b in model["merges"]]
        ranks = {pair: i for i, pair in enumerate(merges)}
        self.table = PrefixTable({ends(p): i for p, i in model["vocab"].items()}, lambda a, b: ranks.get((a, b)), self._symbols)
        self.longest = max(map(len, map(ends, model["vocab"])))
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"])) if spec["added_tokens"] else None
        self._cache, self._words = Recent(CHUNKS), Recent(CHUNKS)
        # how the library writes the bytes of a word: each Latin letter of the plain stretches, by asking it
        pairs = [(b, w) for c in map(chr, range(0xC0, 0x250)) if c.isalpha() and c != "İ" for b, w in zip(c.encode().decode("latin-1"), self.words(c)[0][0])]
        self.shown = str.maketrans(dict(pairs))

    @staticmethod
    def _symbols(word: str) -> list[str]:
        return [*word[:-2], word[-2:]] if word.endswith(_END) else list(word)

    def word_prefixes(self, word: str) -> list[int]:
        """Tokens of each prefix of a word (of the library's pre-tokenised form), the prefix taken as a word of its own."""
        last, count = self.table.counts(word)
        out = []
        for n in range(1, len(word) + 1):
            # the one token that closes the prefix: it ends the word, and may follow what the table has where it starts
            for at in range(max(0, n + 1 - self.longest), n):
                token = self.table_id(word[at:n] + _END)
                if token is not None and (at == 0 or last[at] is not None) and self.table.whole(token) and (at == 0 or self.table.neighbours(last[at], token)):
                    out.append(count[at] + 1)
                    break
        return out

    def table_id(self, piece: str) -> int | None:
        found = self.table.automaton.get(piece, None)
        return None if found is None else found[1]

    def chunk_prefixes(self, chunk: str) -> list[int]:
        """Tokens of each prefix of a chunk, from the empty one to the whole."""
        out, at = [0], 0
        for found in self.special.finditer(chunk) if self.special else ():
            self._part_prefixes(chunk[at : found.start()], out)
            # until a special string is complete, what stands before it and its beginning are cut into words together
            before = out[-1]
            base = out[at]
            for end in range(found.start() + 1, found.end()):
                out.append(base + self.chunk(chunk[at:end]))
            out.append(before + 1)
            at = found.end()
        self._part_prefixes(chunk[at:], out)
        return out

    def _part_prefixes(self, part: str, out: list[int]) -> None:
        """Appends the tokens of each prefix of a stretch without special strings, counted on from the last number in ``out``."""
        if not part:
            return
        base = out[-1]
        # normal forms don't reach over the bounds of grapheme clusters
        clusters = _CLUSTER.findall(part)
        normal = [self.normalise(c) for c in clusters]
        text = "".join(normal)
        ends = list(accumulate(map(len, normal)))
        words = self.words(text)
        starts = [span[0] for _, span in words]
        upto = [0, *accumulate(self.word(w) for w, _ in words)]
        known: dict[int, list[int]] = {}

        def tokens(end: int) -> int:
            """Tokens of the first ``end`` characters of the normalised text."""
            i = bisect_right(starts, end - 1) - 1
            if i < 0:
                return 0
            word, (a, b) = words[i]
            if end >= b:
                return upto[i + 1]
            piece = self.words(text[a:end]) if word[:1] == "'" and b - a < 4 else None
            if piece is not None:  # a contraction's beginning may be two words
                return upto[i] + sum(self.word(w) for w, _ in piece)
            if i not in known:
                known[i] = self.word_prefixes(word)
            return upto[i] + known[i][len(text[a:end].encode("utf-8")) - 1]

        before = 0
        for cluster, form, end in zip(clusters, normal, ends):
            for n in range(1, len(cluster)):
                # within a cluster: its beginning has a normal form of its own
                i = bisect_right(starts, before - 1) - 1
                a = starts[i] if i >= 0 and before else 0
                piece = text[a:before] + self.normalise(cluster[:n])
                out.append(base + (upto[i] if i >= 0 and before else 0) + sum(self.word(w) for w, _ in self.words(piece)))
            out.append(base + tokens(end))
            before = end

    def chunk(self, chunk: str) -> int:
        """Tokens of a stretch without white space."""
        if (known := self._cache.get(chunk)) is not None:
            return known
        n, parts = 0, [chunk]
        if self.special and self.special.search(chunk):
            parts, n = self.special.split(chunk), len(self.special.findall(chunk))
        for part in filter(None, parts):
            if _PLAIN.fullmatch(part):
                for word in _WORDS.findall(part.lower()):
                    n += self.word(word if word.isascii() else word.encode().decode("latin-1").translate(self.shown))
            else:
                for word, _ in self.words(self.normalise(part)):
                    n += self.word(word)
        if len(chunk) <= 64:
            self._cache.keep(chunk, n)
        return n

    def word(self, word: str) -> int:
        """Tokens of a word in the form that the library's pre-tokeniser gives."""
        if (known := self._words.get(word)) is None:
            known = self.table.counts(word + _END)[1][-1]
            if len(word) <= 64:
                self._words.keep(word, known)
        return known

    def chunks(self, text: str) -> list[str]:
        return _BLANK.findall(text) if _ODD_SPACE.search(text) else text.split()

    def counts(self, text: str) -> list[int]:
        """Tokens of the text up to the end of each chunk: the table that prefix questions read."""
        total, out, get, chunk = 0, [], self._cache.young.get, self.chunk
        for c in self.chunks(text):
            n = get(c)
            total += chunk(c) if n is None else n
            out.append(total)
        return out

    def fits(self, text: str, budget: int, counts: list[int] | None = None) -> int:
        """Characters of the longest prefix that has at most ``budget`` tokens, from the ``counts`` of the text."""
        chunks = self.chunks(text)
        counts = self.counts(text) if counts is None else counts
        i = bisect_right(counts, budget)
        if i == len(counts):
            return len(text)
        at = 0
        for chunk in chunks[:i]:
            at = text.index(chunk, at) + len(chunk)
        at = text.index(chunks[i], at)
        room = budget - (counts[i - 1] if i else 0)
        inside = self.chunk_prefixes(chunks[i])
        return at + max(n for n, tokens in enumerate(inside) if tokens <= room)


@lru_cache(maxsize=2)
def counter(file: str) -> Counter:
    return Counter(file)


def token_counts(docs: DataFrame, file: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row: id, n_bytes, n_tokens, over_limit and fit_chars (characters of the longest prefix within the limit).

    A null text is an empty one: no bytes, no tokens. Texts are counted whole, repeated rows each for itself; other columns
    of ``docs``, whatever their names, are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = counter(file)
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["_id"], pdf["_text"]):
                text = text if isinstance(text, str) else ""
                counts = tool.counts(text)
                total = counts[-1] if counts else 0
                out.append((doc, len(text.encode("utf-8")), total, total > limit, tool.fits(text, limit, counts) if total > limit else len(text)))
            frame = pd.DataFrame(out, columns=["_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])
            frame["_id"] = frame["_id"].astype("Int64")
            yield frame

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInPandas(tidy(run), "_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long").withColumnRenamed("_id", id_col)
