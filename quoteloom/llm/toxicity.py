"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words (edge punctuation cut), word pairs and pairs that skip one word, and the starts of its
words (4 and 5 letters, for stems; on the held-out fold of sf0.1 they bring 103 instead of 95 of 120 toxic texts, at 3 instead
of 0 of 870 clean ones), hashed into ``2 ** BITS`` places.  Every coordinate has its own rate, and an L1 term
keeps most weights at exactly zero, so the model that is broadcast is some hundred (place, weight) pairs.  Learning is
sequential: it runs in one task over at most TOXIC + CLEAN labelled texts (a documented bound; the choice is by a
hash of doc_id, so it depends neither on order nor on partitions); their features are made in parallel before.  All
labels are counted, and the log of the odds ratio of all to the learned ones is added to the intercept, so that scores
follow the classes as they are, however many of each the bound leaves.
Scoring reads every text whole, without a shuffle.

Edge cases: null and empty texts get the score of the intercept alone; labels that are null, contradict each other or
belong to no document teach nothing; repeated rows of a doc_id are scored each, teach once (by the greatest of their texts) and
count each in the ratio of the classes; without toxic labels to learn from every score is
0 (to 15 digits), with toxic ones alone 1; other columns, whatever their names, never enter a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, mix64, save, words

BITS = 22
#: Most labelled texts of each class that the model learns from.
TOXIC, CLEAN = 4_000, 8_000
THRESHOLD = 0.3
EDGE = b".,;:!?\"'()[]{}<>*_-|%#$&/\\"
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 4.0, 0.5, 4


class Hashes(WordHashes):
    """Hash of a word without its edge punctuation, or of its first ``letters`` letters."""

    def __init__(self, letters: int = 0) -> None:
        super().__init__()
        self.letters = letters

    def __missing__(self, word: bytes) -> int:
        bare = word.strip(EDGE) or word
        if self.letters:
            bare = bare.decode("utf-8", "replace")[: self.letters].encode("utf-8", "replace")
        self[word] = h = xxhash.xxh3_64_intdigest(bare, seed=self.letters)
        return h


def caches() -> list[Hashes]:
    return [Hashes(), Hashes(4), Hashes(5)]


def places(text: str | None, by: list[Hashes]) -> np.ndarray:
    """Feature places of a text, not yet distinct."""
    ws = words(text)
    h = by[0].of(ws)
    pair = mix64(h[:-1] * np.uint64(3) + h[1:])
    skip = mix64(h[:-2] * np.uint64(5) + h[2:])
    return (np.concatenate([h, pair, skip, by[1].of(ws), by[2].of(ws)]) >> np.uint64(64 - BITS)).astype(np.int32)


class Ftrl:
    """Per-coordinate FTRL-proximal with binary features; place 2 ** BITS is the intercept, which is not regularised."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, free = self.z[at], at == 2**BITS
        l1 = np.where(free, 0.0, L1)
        w = -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + np.where(free, 0.0, L2))
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, 2**BITS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        root = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - root) / ALPHA * w

    def sparse(self, shift: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and weights that are not zero, ``shift`` added to the intercept."""
        at = np.append(np.flatnonzero(self.z[:-1]), 2**BITS)
        w = self.weights(at)
        w[-1] += shift
        return at[w != 0], w[w != 0]


def prior(seen: dict[int, int], real: dict[int, int]) -> float:
    """What the intercept lacks if ``seen`` rows of each class were learned of ``real`` ones: the log of their odds ratio."""
    return math.log(real[1] / real[0]) - math.log(seen[1] / seen[0])


def labelled(docs: DataFrame, labels: DataFrame, learn_from: Column) -> DataFrame:
    """(id, toxic, rows) of all labelled documents to learn from; rows: how often the document stands in the table."""
    clear = labels.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most and doc_id is not null")
    clear = clear.where(learn_from).select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    return docs.select("doc_id").join(clear, F.col("doc_id") == F.col("id")).groupBy("id", "toxic").agg(F.count("*").alias("rows"))


def sample(known: DataFrame) -> DataFrame:
    """(id, toxic) of the documents that the model learns from."""
    order = F.xxhash64("id", F.lit("toxicity")), F.col("id")
    return known.where("toxic = 1").orderBy(*order).limit(TOXIC).union(known.where("toxic = 0").orderBy(*order).limit(CLEAN)).select("id", "toxic")


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of the non-zero coordinates."""

    def featurise(batches):
        by = caches()
        for b in batches:
            at = [np.unique(places(t, by)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("toxic"), pa.array(at, pa.list_(pa.int32()))], names=["id", "toxic", "at"])

    known = save(labelled(docs, labels, learn_from), "labelled")
    real = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.sum("rows").alias("n")).collect()}

    def learn(batches):
        rows = [(i, y, a.values.to_numpy()) for b in batches for i, y, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True)]
        rows.sort(key=lambda r: (r[0], len(r[2])))
        seen = Counter(y for _, y, _ in rows)
        at, w = np.array([2**BITS]), np.array([35.0 if set(seen) == {1} else -35.0])  # one class: the intercept alone
        if len(seen) == 2:
            model, order = Ftrl(), np.random.default_rng(0)
            for _ in range(EPOCHS):
                for i in order.permutation(len(rows)):
                    model.learn(rows[i][2], rows[i][1])
            at, w = model.sparse(prior(seen, real))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w, pa.float64())], names=["at", "w"])

    ids = F.broadcast(sample(known))  # TOXIC + CLEAN rows at most
    learned = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("id"))
    # one row a doc_id, however often it stands in the table: of its texts the greatest
    learned = learned.groupBy("id", "toxic").agg(F.max("text").alias("text"))
    made = learned.mapInArrow(featurise, "id long, toxic int, at array<int>")
    # one task: TOXIC + CLEAN rows at most
    model = save(made, "toxicity").coalesce(1).mapInArrow(learn, "at int, w double").toPandas()
    if model.empty:  # no labelled text, and so no task
        return np.array([2**BITS]), np.array([-35.0])
    return model["at"].to_numpy(), model["w"].to_numpy()


def scorer(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None):
    """Learns from ``labels`` (doc_id, toxic) and returns a function from a text column to its score, 0 to 1."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, F.lit(True) if learn_from is None else learn_from))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        by, (at, w) = caches(), model.value
        dense = np.zeros(2**BITS + 1, np.float32)
        dense[at] = w
        for texts in parts:
            out = np.empty(len(texts))
            for i, text in enumerate(texts):
                found = places(text, by)
                found = np.unique(found[dense[found] != 0])
                out[i] = dense[found].sum(dtype=float) + dense[-1]
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return score


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below THRESHOLD."""
    return docs.where(scorer(docs, labels)(F.col("text")) < THRESHOLD)
