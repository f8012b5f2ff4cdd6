"""Helpers shared by the corpus operators: word rules, stable hashes, written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: U+0020 and U+0009 to U+000D. ``bytes.split()`` uses exactly this set.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"

#: Bytes of text that one vectorised step handles; a longer document is a step of its own.
STEP_BYTES = 1_000_000

_U64 = np.uint64
_BYTE_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def tidy(f):
    """``f`` over a task's batches; when the task ends, memory that is free goes back, since a worker stays for later tasks."""

    def over(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow

        yield from f(batches)
        pyarrow.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return over


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share; a temporary one where it is unset and all is one machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="corpusmill-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut and a lost executor costs nothing that was done."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x + _U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
        return x ^ (x >> _U64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=_U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, b, dtype=_U64)
                steps[0] = 1
                with np.errstate(over="ignore"):
                    setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_BYTES = Powers(_BYTE_BASE)


class Words:
    """The words of several texts: byte offsets in ``data``, hash and text number of each."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(self.data, dtype=np.uint8)
        space = _IS_SPACE[raw]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        up, down = _BYTES.get(len(raw) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, dtype=_U64), np.add.accumulate((raw.astype(_U64) + _U64(1)) * up[: len(raw)])))
            self.hash = mix((total[self.end] - total[self.start]) * down[self.start])
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.offset = np.cumsum(lengths) - lengths
        self.first = np.searchsorted(self.start, np.concatenate((self.offset, [len(raw)])))
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)


def gram_hashes(words: np.ndarray, n: int, powers: Powers) -> np.ndarray:
    """Hashes of all runs of n consecutive words (of the whole array; the caller drops those across texts)."""
    if len(words) < n:
        return np.zeros(0, dtype=_U64)
    up, down = powers.get(len(words) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, dtype=_U64), np.add.accumulate(words * up[: len(words)])))
        return mix((total[n:] - total[:-n]) * down[: len(words) - n + 1])


def run_hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Hashes of the runs words[start:end] of any length."""
    up, down = powers.get(len(words) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, dtype=_U64), np.add.accumulate(words * up[: len(words)])))
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(_U64))


def steps(texts: Iterable[bytes], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about ``limit`` bytes each."""
    texts = list(texts)
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def encoded(series) -> list[bytes]:
    """Texts as UTF-8 (null: empty); lone surrogates can't occur in what Spark holds."""
    return [t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in series]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id``, ``_text`` and ``_key``: the id with a hash of the text names a row up to repeated rows, whatever other columns exist."""
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).withColumn("_key", F.xxhash64("_text"))
