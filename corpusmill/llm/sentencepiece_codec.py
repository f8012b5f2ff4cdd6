"""SentencePiece encoding and decoding of whole texts with a public merge-type model, by the prefix table."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import steps, tidy
from corpusmill.llm.prefix_table import PrefixTable, Recent

_SPACE = "▁"
#: A stretch longer than this is not kept in the cache; stretches in the cache's young half.
LONG, STRETCHES = 64, 160_000


class Codec:
    """Exact ids of a sentencepiece BPE model with identity normalisation, dummy prefix and byte fallback.

    The text is taken apart where no token can reach over: before a run of spaces, and around line ends. Each stretch is
    encoded by the prefix table; characters without token become their UTF-8 bytes' tokens.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        kinds = [(i, model.id_to_piece(i)) for i in range(model.get_piece_size())]
        self.eos = model.eos_id()
        self.byte = {int(p[1:-1], 16): i for i, p in kinds if model.is_byte(i)}
        pieces = {p: i for i, p in kinds if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        if any("\n" in p or re.search(f"[^{_SPACE}]{_SPACE}", p) for p in pieces) or model.normalize("a  bﬁ ") != f"{_SPACE}a{_SPACE * 2}bﬁ{_SPACE}":
            raise ValueError("the model has another kind of normalisation or tokens that reach over spaces")
        order = {p: -model.get_score(i) for p, i in pieces.items()}
        self.table = PrefixTable(pieces, lambda a, b: order.get(a + b), list)
        self.shown = {i: p.replace(_SPACE, " ") for p, i in pieces.items()} | {i: "" for i, _ in kinds if model.is_control(i)}
        self.shown |= {i: " ⁇ " for i, _ in kinds if model.is_unknown(i)}
        self.shown |= {i: chr(b) for b, i in self.byte.items() if b < 128}
        self.value = {i: b for b, i in self.byte.items() if b >= 128}
        self.written = {i: str(i) for i, _ in kinds}
        self._stretch = re.compile(f"{_SPACE}+[^{_SPACE}\n]*|[^{_SPACE}\n]+|\n")
        self._cache = Recent(STRETCHES)

    def _encode(self, stretch: str) -> tuple[int, ...]:
        if (known := self._cache.get(stretch)) is not None:
            return known
        backwards: list[int] = []
        for token, a, b in self.table.spans(stretch):
            if token == PrefixTable.UNKNOWN:
                backwards += [self.byte[x] for x in reversed(stretch[a:b].encode("utf-8"))]
            else:
                backwards.append(token)
        ids = tuple(backwards[::-1])
        if len(stretch) <= LONG:
            self._cache.keep(stretch, ids)
        return ids

    def encode(self, text: str) -> list[int]:
        """The ids, without begin or end; none for an empty text."""
        ids: list[int] = []
        if text:
            get, encode = self._cache.young.get, self._encode
            for stretch in self._stretch.findall(_SPACE + text.replace(" ", _SPACE)):
                ids += get(stretch) or encode(stretch)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of some ids: byte tokens become characters again (U+FFFD for each byte that is none), one leading space goes."""
        if self.value.keys().isdisjoint(ids):
            text = "".join(map(self.shown.__getitem__, ids))
        else:
            parts, held = [], bytearray()
            for i in ids:
                if i in self.value:
                    held.append(self.value[i])
                else:
                    parts += [*_characters(held), self.shown[i]]
                    held.clear()
            text = "".join([*parts, *_characters(held)])
        first = next((i for i in ids if self.shown.get(i) != ""), None)
        return text[1:] if text.startswith(" ") and first is not None and self.shown.get(first, "")[:1] == " " and first not in self.byte.values() else text


def _characters(held: bytearray) -> Iterator[str]:
    at = 0
    while at < len(held):
        for size in (2, 3, 4):
            try:
                yield bytes(held[at : at + size]).decode("utf-8")
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            yield "�"
            at += 1


@lru_cache(maxsize=2)
def codec(model_file: str) -> Codec:
    return Codec(model_file)


def encode_texts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Of each row: id, n_tokens (end id included), ``ids`` and ``decoded`` if asked for, and the SHA-256 of both.

    A null text is an empty one: its only id is the end. The file must be at the same path on every executor.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = codec(model_file)
        for pdf in batches:
            for a, b in steps(t if isinstance(t, str) else "" for t in pdf["_text"]):
                out = []
                for doc, text in zip(pdf["_id"].iloc[a:b], pdf["_text"].iloc[a:b]):
                    ids = [*tool.encode(text if isinstance(text, str) else ""), tool.eos]
                    decoded = tool.decode(ids)
                    joined = " ".join(map(tool.written.__getitem__, ids))
                    out.append((doc, len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), *([ids, decoded] if with_ids else [])))
                frame = pd.DataFrame(out, columns=["_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * with_ids])
                frame["_id"] = frame["_id"].astype("Int64")
                yield frame

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    out = rows.mapInPandas(tidy(run), "_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids)
    return out.withColumnRenamed("_id", id_col)


def decode_ids(encoded: DataFrame, model_file: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """Adds the text of an array of ids; null ids give null."""
    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        tool = codec(model_file)
        return ids.map(lambda x: None if x is None else tool.decode(list(x)))

    return encoded.withColumn(out_col, text(F.col(ids_col)))
