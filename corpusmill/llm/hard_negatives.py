"""Hard negatives by exact scores from a residue number system.

Integer vectors are taken modulo several primes below 2**10. A product of such residue matrices in float32 is exact, since 64
products of balanced residues stay below 2**24; longer vectors are reduced after each 64 components. Balanced mixed-radix
digits (Garner's form of Chinese remaindering) then give the exact signed score. Scores are made slice by slice: a first pass
finds each anchor's best rows of its own label, a second one the best rows of other labels inside each positive's window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import written
from corpusmill.llm.slices import VECTORS_AT_ONCE, first_k, matrix, past_slices, slices_for, trimmed, usable

#: Components multiplied before a reduction: 64 * 510**2 < 2**24, what float32 adds exactly.
EXACT_TERMS, PRIME_LIMIT = 64, 1024


def primes(least_product: int) -> list[int]:
    """The largest primes below PRIME_LIMIT, as many as their product needs to pass ``least_product``."""
    out, product = [], 1
    for p in range(PRIME_LIMIT - 1, 2, -2):
        if product > least_product:
            break
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            out.append(p)
            product *= p
    return out


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo an odd p, from -(p - 1) / 2 to (p - 1) / 2."""
    return (x + p // 2) % p - p // 2


def moduli_for(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Primes whose product tells all inner products of rows of a and b apart, by the product of the largest norms."""
    norm = lambda m: float(np.sqrt((m.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
    return primes(2 * int(norm(a) * norm(b) * (1 + 1e-9) + 1) + 1)


def residues(m: np.ndarray, moduli: list[int]) -> list[np.ndarray]:
    return [balanced(m, p).astype(np.float32) for p in moduli]


def products(a: list[np.ndarray], b: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """Exact inner products of all rows of two integer matrices from their residues."""
    digits: list[np.ndarray] = []
    total, weight = 0, 1
    for i, p in enumerate(moduli):
        rest = np.zeros((len(a[i]), len(b[i])), dtype=np.int32)
        for at in range(0, a[i].shape[1], EXACT_TERMS):
            rest = (rest + (a[i][:, at : at + EXACT_TERMS] @ b[i][:, at : at + EXACT_TERMS].T).astype(np.int32)) % p
        # what the digits so far leave, divided by each earlier prime in turn
        for q, digit in zip(moduli, digits):
            rest = (rest - digit) * pow(q, -1, p) % p
        digits.append(balanced(rest, p))
        with np.errstate(over="ignore"):
            total = total + digits[-1].astype(np.int64) * np.array(weight % 2**64, dtype=np.uint64).astype(np.int64)
        weight *= p
    return total


def _scores(held: pa.RecordBatch, asked: pa.RecordBatch):
    """Where vectors of the slice begin, and their scores with the queries, some vectors at a time."""
    rows, queries = matrix(held), matrix(asked)
    moduli = moduli_for(rows, queries)
    left = residues(queries, moduli)
    for at in range(0, len(rows), VECTORS_AT_ONCE):
        yield at, products(left, residues(rows[at : at + VECTORS_AT_ONCE], moduli), moduli)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _best_of_own_label(k: int):
    def best(held: pa.RecordBatch, asked: pa.RecordBatch) -> pa.RecordBatch:
        ids, labels, names, own = _column(held, "_id"), _column(held, "_label"), _column(asked, "_id"), _column(asked, "_label")
        found = []
        for at, scores in _scores(held, asked):
            part = slice(at, at + scores.shape[1])
            x, y = first_k(scores, (labels[None, part] == own[:, None]) & (ids[None, part] != names[:, None]), k)
            found.append((x, scores[x, y], at + y))
        x, score, y = trimmed(*(np.concatenate(c) for c in zip(*found)), k)
        return pa.RecordBatch.from_pydict({"anchor_id": names[x], "positive_id": ids[y], "positive_score": score})

    return best


def _best_in_windows(k: int, low: int, high: int, of: int):
    """For each query and place of its ``_positives``: the first rows of other labels with low * positive <= of * score <= high * positive."""

    def best(held: pa.RecordBatch, asked: pa.RecordBatch) -> pa.RecordBatch:
        ids, labels, names, own = _column(held, "_id"), _column(held, "_label"), _column(asked, "_id"), _column(asked, "_label")
        positives = asked.column("_positives").to_pylist()
        most = max(map(len, positives))
        known = np.asarray([[j < len(p) for j in range(most)] for p in positives], dtype=bool).reshape(len(names), most)
        limit = np.asarray([[p[j] if j < len(p) else 0 for j in range(most)] for p in positives], dtype=np.int64).reshape(len(names), most)
        found: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(most)]
        for at, scores in _scores(held, asked):
            part = slice(at, at + scores.shape[1])
            other = (labels[None, part] != own[:, None]) & (ids[None, part] != names[:, None])
            for j in range(most):
                window = (of * scores >= low * limit[:, j, None]) & (of * scores <= high * limit[:, j, None])
                x, y = first_k(scores, other & window & known[:, j, None], k)
                found[j].append((x, scores[x, y], at + y))
        x, score, y = zip(*(trimmed(*(np.concatenate(c) for c in zip(*one)), k) for one in found))
        places = np.repeat(np.arange(most, dtype=np.int32), list(map(len, x)))
        x, score, y = np.concatenate(x), np.concatenate(score), np.concatenate(y)
        return pa.RecordBatch.from_pydict({"anchor_id": names[x], "_place": places, "negative_id": ids[y], "negative_score": score})

    return best


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    of: int = 100,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: hard negatives of each anchor and positive.

    A row's score is the inner product of floor(scale * vector) with the anchor's; higher ones come first, ties by smaller id.
    An anchor's positives are its first other rows of the same label. A positive's negatives are the first rows of another
    label with low * positive_score <= of * negative_score <= high * positive_score, so one with a negative score has none.
    All are returned where there are fewer. Rows with a null id, label or vector, an empty vector, or null or non-finite
    components take no part, and only vectors of the anchor's length are scored. Anchors of the same id count as one (the
    least label and vector); rows of an anchor's own id are neither its positives nor its negatives; other repeated rows each
    count. An empty table gives an empty result. Other columns, whatever their names, play no part. Scores are exact while
    ``of`` times a score fits a long.
    """
    v = F.col(vector_col)
    good = vectors.where(F.col(id_col).isNotNull() & label.isNotNull() & usable(v))
    ints = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    rows = written(good.select(F.col(id_col).cast("long").alias("_id"), label.cast("long").alias("_label"), ints.alias("_v"), F.coalesce(is_anchor, F.lit(False)).alias("_anchor")), "vectors")
    anchors = written(rows.where("_anchor").groupBy("_id").agg(F.min(F.struct("_label", "_v")).alias("_r")).select("_id", "_r._label", "_r._v"), "anchors")
    rows, slices = rows.drop("_anchor"), slices_for(rows)

    near = past_slices(rows, anchors, slices, _best_of_own_label(positives), "anchor_id long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    best = written(near.withColumn("_place", place - 1).where(F.col("_place") < positives), "positives")
    lists = best.groupBy(F.col("anchor_id").alias("_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "positive_score"))), lambda s: s["positive_score"]).alias("_positives"))

    asked = anchors.join(lists, "_id")
    empty = rows.withColumn("_positives", F.lit(None).cast("array<long>"))
    far = past_slices(empty, asked, slices, _best_in_windows(negatives, low, high, of), "anchor_id long, _place int, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "_place").orderBy(F.desc("negative_score"), "negative_id"))
    chosen = far.withColumn("rank", rank.cast("int")).where(F.col("rank") <= negatives)
    return chosen.join(best, ["anchor_id", "_place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
