"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, are trained from document labels.

A sentence has the features of its words: the word, its beginnings and its character runs. Its score is a
logistic function of their weights; a document is clean if all of its sentences are, so its score is
1 - (1 - leak) * product of (1 - sentence score). The weights are those that make the labels of a bounded sample of
documents likeliest: tasks count the features of whole texts and turn these into bags of feature numbers, and one task
trains on the bags. The sentence scores then show where the offence stands.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import steps, tidy, written

#: Features that get a weight at most.
FEATURES = 20_000
#: Labelled rows that training uses at most, those of the smallest hash of their id, each with its whole text.
TRAIN_ROWS = 6000
#: Toxic documents that a feature stands in at least, if it gets a weight.
LEAST_DOCS = 4
#: Least G statistic of a feature that gets a weight.
LEAST_G = 14.0
_SENTENCE = re.compile(r"[^.!?\n。]+")
_EDGE = "\"'()[]{}<>,;:*#$%&|-_/\\"
_BREAK = str.maketrans(".!?。", "    ")


def names(word: str) -> set[str]:
    """The features of a word: itself, its beginnings, and its runs of 3 to 5 characters; the first letter tells the kind."""
    return {f"w{word}", *(f"p{word[:n]}" for n in range(3, 8) if len(word) > n), *(f"g{word[i : i + n]}" for n in (3, 4, 5) for i in range(len(word) - n + 1))}


class Features:
    """Numbers of those features of a word that are chosen, kept for words already seen."""

    def __init__(self, chosen: list[str]):
        self.whole, self.begin, self.inside = ({name[1:]: i for i, name in enumerate(chosen) if name[0] == kind} for kind in "wpg")
        self.known: dict[str, tuple[int, ...]] = {}

    def word(self, word: str) -> tuple[int, ...]:
        if len(self.known) > 100_000:
            self.known.clear()
        bare = word.strip(_EDGE)
        inside, found = self.inside, set()
        for n in (3, 4, 5):
            for i in range(len(bare) - n + 1):
                if (x := bare[i : i + n]) in inside:
                    found.add(inside[x])
        for n in range(3, 8):
            if len(bare) > n and (x := bare[:n]) in self.begin:
                found.add(self.begin[x])
        if bare in self.whole:
            found.add(self.whole[bare])
        out = tuple(sorted(found))
        if len(word) < 40:
            self.known[word] = out
        return out


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.findall(text) if s.strip()]


def bags(texts: list[str], features: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct feature numbers of all sentences one after another, features of each sentence, sentences of each text."""
    flat: list[int] = []
    sizes: list[int] = []
    many: list[int] = []
    get, look = features.known.get, features.word
    for text in texts:
        split = sentences(text.lower())
        many.append(len(split))
        for sentence in split:
            bag: set[int] = set()
            for w in sentence.split():
                if (known := get(w)) is None:
                    known = look(w)
                if known:
                    bag.update(known)
            flat += bag
            sizes.append(len(bag))
    return np.asarray(flat, dtype=np.int64), np.asarray(sizes, dtype=np.int64), np.asarray(many, dtype=np.int64)


def summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values)))
    edge = np.concatenate(([0], np.cumsum(sizes)))
    return total[edge[1:]] - total[edge[:-1]]


def _kinds(text: str) -> set[str]:
    """The features of a text's different words."""
    words = {w.strip(_EDGE) for w in set(text.lower().translate(_BREAK).split())}
    return {x for w in words for x in names(w)}


def telling(sample: DataFrame, most: int = FEATURES) -> list[str]:
    """The features that stand in significantly more of the toxic documents of a sample (_text, _label) by the G statistic, strongest first."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held = [Counter(), Counter()]
            for text, label in zip(pdf["_text"].fillna(""), pdf["_label"]):
                held[int(label)].update(_kinds(text))
            every = list(held[0].keys() | held[1].keys())
            yield pd.DataFrame({"name": np.asarray(every, dtype=object), "clean": [held[0][x] for x in every], "toxic": [held[1][x] for x in every]})

    many = {r["_label"]: r["count"] for r in sample.groupBy("_label").count().collect()}
    counts = sample.select("_text", "_label").mapInPandas(tidy(counted), "name string, clean long, toxic long").groupBy("name").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("toxic") >= LEAST_DOCS)
    n0, n1 = max(1, many.get(0, 0)), max(1, many.get(1, 0))
    share = lambda x, n: F.least(F.greatest(x / n, F.lit(1e-9)), F.lit(1 - 1e-9))
    both = share(F.col("clean") + F.col("toxic"), n0 + n1)
    part = lambda x, n: x * F.log(share(x, n) / both) + (n - x) * F.log((1 - share(x, n)) / (1 - both))
    g = counts.where(F.col("toxic") / n1 > F.col("clean") / n0).select("name", F.round(2 * (part(F.col("clean"), n0) + part(F.col("toxic"), n1)), 9).alias("g"))
    return [r["name"] for r in g.where(F.col("g") > LEAST_G).orderBy(F.desc("g"), "name").limit(most).collect()]


def numbered(sample: DataFrame, chosen: list[str]) -> DataFrame:
    """_id, _key, _label and the bags of each row's whole text: ``flat`` feature numbers, ``sizes`` of the sentences that have any, and how many have none (``bare``)."""
    held = sample.sparkSession.sparkContext.broadcast(chosen)  # at most FEATURES short strings, whatever the input

    def bagged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features(held.value)
        for pdf in batches:
            out = []
            for text in pdf["_text"].fillna(""):
                flat, sizes, _ = bags([text], features)
                out.append((flat.astype(np.int32), sizes[sizes > 0].astype(np.int32), int((sizes == 0).sum())))
            yield pd.DataFrame(out, columns=["flat", "sizes", "bare"]).assign(_id=pdf["_id"].to_numpy(), _key=pdf["_key"].to_numpy(), _label=pdf["_label"].to_numpy())

    rows = sample.withColumn("_key", F.xxhash64("_text"))
    return rows.mapInPandas(tidy(bagged), "flat array<int>, sizes array<int>, bare long, _id long, _key long, _label int")


def train(bagged: pd.DataFrame, features: int, epochs: int = 200, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights of the features, then the sentence bias and the leak's logit, from the rows of ``numbered``.

    Adam on the likelihood of the labels under noisy-or, with a penalty on squared weights. Weights start at zero and the
    bias well below it, so that a sentence is clean until a label says otherwise. Sentences without features have the
    bias for a score and are only counted.
    """
    join = lambda c: np.concatenate([np.zeros(0, dtype=np.int64), *[np.asarray(x, dtype=np.int64) for x in bagged[c]]])
    index, sizes, bare = join("flat"), join("sizes"), bagged["bare"].to_numpy(dtype=float)
    many = np.fromiter(map(len, bagged["sizes"]), dtype=np.int64, count=len(bagged))
    labels = bagged["_label"].to_numpy()
    w = np.zeros(features + 2)
    w[-2:] = -5.0, -4.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, epochs + 1):
        g = gradient(w, index, sizes, many, bare, labels, decay)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w


def gradient(w: np.ndarray, index: np.ndarray, sizes: np.ndarray, many: np.ndarray, bare: np.ndarray, labels: np.ndarray, decay: float) -> np.ndarray:
    """How the mean negative log-likelihood of the labels, with half of ``decay`` times the squared weights, changes with each of ``w``.

    A document is toxic unless none of its sentences offends and its leak doesn't either; ``index`` has the features of all
    sentences one after the other, ``sizes`` how many each has, ``many`` the sentences of each document and ``bare`` those
    without features.
    """
    sentence_of, doc_of = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(len(many)), many)
    chance = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    p, none, leak = chance(summed(w[index], sizes) + w[-2]), chance(w[-2]), chance(w[-1])
    # -log of the chance of no offence
    clean = summed(-np.log1p(-np.minimum(p, 1 - 1e-12)), many) - bare * np.log1p(-none) - np.log1p(-leak)
    pull = np.where(labels == 1, -np.exp(-clean) / np.maximum(1 - np.exp(-clean), 1e-9), 1.0) / max(1, len(labels))
    gz = pull[doc_of] * p
    g = np.zeros_like(w)
    g[:-2] = np.bincount(index, weights=gz[sentence_of], minlength=len(w) - 2) + decay * w[:-2]
    g[-2], g[-1] = gz.sum() + (pull * bare).sum() * none, (pull * leak).sum()
    return g


class Model:
    """Trained weights, ready to score."""

    def __init__(self, weights: dict[str, float]):
        chosen = [x for x in weights if x not in ("", "?")]
        self.features = Features(chosen)
        self.weights = np.asarray([weights[x] for x in chosen] or [0.0])
        self.bias, self.leak = weights.get("", -5.0), weights.get("?", -4.0)

    def score(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Sentence scores of each text, and each text's own score."""
        index, sizes, many = bags(texts, self.features)
        p = 1 / (1 + np.exp(-np.clip(summed(self.weights[index], sizes) + self.bias, -30, 30)))
        log = summed(np.log1p(-np.minimum(p, 1 - 1e-12)), many) - np.log1p(np.exp(self.leak))
        return np.split(p, np.cumsum(many)[:-1]), 1 - np.exp(log)


def sample_of(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """_id, _text and _label of at most ``rows`` labelled documents, those of the smallest hash of the id.

    Ids whose crc32 (of the id as text) is divisible by 5 are held out. Rows with a null id or label take no part; an id
    that is labelled twice counts as labelled 1 if either label is.
    """
    marks = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_id IS NOT NULL AND _label IS NOT NULL")
    marks = marks.where(~held_out("_id")).groupBy("_id").agg(F.max("_label").alias("_label"))
    chosen = marks.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    # at most `rows` rows of two numbers are broadcast
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")


def fit(sample: DataFrame) -> dict[str, float]:
    """The weights by feature name, the sentence bias (name "") and the leak's logit (name "?"), from a bounded sample (_id, _text, _label).

    Whole texts are counted and turned into bags where they lie; one task trains on the bags, and the sample's bound keeps
    its rows the same whatever the corpus's size.
    """
    chosen = telling(sample)

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({c: [] for c in ("flat", "sizes", "bare", "_id", "_key", "_label")}), *batches], ignore_index=True)
        yield pd.DataFrame({"weight": train(rows.sort_values(["_id", "_key"]), len(chosen))})

    # rows stay in order within the one batch stream
    weights = [r["weight"] for r in numbered(sample, chosen).repartition(1).mapInPandas(tidy(fitted), "weight double").collect()]
    return dict(zip([*chosen, "", "?"], weights))


def toxicity_scores(docs: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, worst: bool = False) -> DataFrame:
    """Id (or the columns ``keep``), score in 0..1, predicted (1 from 0.5) and, with ``worst``, the sentences that score 0.5 or more.

    Null and empty texts have no sentence and get the leak, the score of an offence without one. Texts are scored whole,
    repeated rows each for itself; other columns of ``docs`` only come along if ``keep`` names them.
    """
    held = docs.sparkSession.sparkContext.broadcast(weights)  # at most FEATURES short strings, whatever the input
    columns = [F.col(c) for c in keep] if keep else [F.col(id_col).cast("long").alias(id_col)]

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Model(held.value)
        for series in batches:
            texts = [t if isinstance(t, str) else "" for t in series]
            score, found = np.zeros(len(texts)), [[] for _ in texts]
            for a, b in steps([t.encode("utf-8", "replace") for t in texts]):
                each, score[a:b] = model.score(texts[a:b])
                if worst:
                    for i in np.flatnonzero(score[a:b] >= 0.5):
                        found[a + i] = [s.strip() for s, p in zip(sentences(texts[a + i]), each[i]) if p >= 0.5]
            yield pd.DataFrame({"score": score, "predicted": (score >= 0.5).astype(np.int32), "worst": found})

    @F.pandas_udf("score double, predicted int, worst array<string>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from tidy(scores)(batches)

    out = docs.select(*columns, scored(F.col(text_col)).alias("_s"))
    return out.select(*[c for c in out.columns if c != "_s"], "_s.score", "_s.predicted", *["_s.worst"] * worst)


def train_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict[str, float]:
    """The weights for a corpus with a label table: at most FEATURES + 2 numbers."""
    return fit(written(sample_of(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col), "labelled"))


def held_out(id_col: str = "doc_id"):
    """Whether a row is in the fold that training never sees."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
