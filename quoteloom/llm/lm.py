"""Document log-probabilities by subword lattices: a unigram model of pieces, summed over all segmentations.

Model.  A text is a sequence of words and an end.  After each word the text ends with the share of ends among the training
tokens; else a word follows.  A word is any sequence of vocabulary pieces that spells it, and an end of the word; its
probability is the sum over all segmentations, by forward recursion in log space (lattice.py).  ``score`` is log10 of the
product, the marginal probability of the text; the probabilities of all texts sum to one.

Fit.  The weights start from those of the existing vocabulary and are fitted to the training words, each as often as it
stands there, by expected counts from forward and backward sums; the existing weights count as PRIOR words.

Further columns.  ``base_score`` is the additive word model that scores are held against.  ``word_score`` gives each known word its
count too, absolutely discounted (Good-Turing, from the words seen once and twice), the lattice getting what is taken away.

Corpus counts and weights come from all training texts: counts are combined in the task, then by word.  Expected
counts are one row for each piece and task.  The HEAD most frequent words (a bound, whatever the corpus) travel to
the tasks that read the texts, each rarer word of a document is one row that meets the table of words.

Edge cases: null and empty texts are an end alone; without training texts the existing weights count, and an end follows a
word as often as not; rows are scored each, repeated ones and those without doc_id too; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, words
from .lattice import MARK, Lattice, existing_vocabulary

HEAD, ROUNDS, PRIOR = 150_000, 3, 100
#: Distinct words that are counted in Python before their counts go on.
COUNTED = 400_000
#: What base scores add to each count.
ADDED = 0.1
END = b"\n"  # no word: words hold no white space
SUMS = ["known", "base", "lattice", "whole"]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): all words and ends of all texts, with their counts in the training texts; docs: (text, learn)."""

    def run(batches):
        held: Counter = Counter()

        def out():
            columns = zip(*held.items(), strict=True) if held else [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64()), strict=True)], names=["word", "n"])
            held.clear()

        for b in batches:
            for text, learn in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                ws = [*words(text.as_py()), END]
                if learn:
                    held.update(ws)
                else:
                    for w in ws:
                        held.setdefault(w, 0)
                if len(held) > COUNTED:
                    yield from out()
        yield from out()

    return docs.select("text", "learn").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit(counted: DataFrame, vocabulary: dict[bytes, float], rounds: int) -> tuple[list[bytes], np.ndarray]:
    """Pieces and their natural log weights after ``rounds`` of expected counts over the training words."""
    pieces = sorted(vocabulary)
    prior = np.array([vocabulary[p] for p in pieces]) * math.log(10)
    weight = prior
    for _ in range(rounds):
        shared = counted.sparkSession.sparkContext.broadcast((pieces, weight))  # one row a piece of the vocabulary

        def run(batches, shared=shared):
            lattice, counts = None, None
            for b in batches:
                if lattice is None:
                    lattice = Lattice(shared.value[0])
                    counts = np.zeros(len(lattice.pieces))
                counts += lattice.expected([MARK + w for w in b.column(0).to_pylist()], shared.value[1], b.column(1).to_numpy().astype(float))
            if counts is not None:
                used = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used])], names=["piece", "n"])

        parts = counted.where((F.col("n") > 0) & (F.col("word") != F.lit(END))).select("word", "n").mapInArrow(run, "piece int, n double")
        sums = parts.groupBy("piece").agg(F.sum("n").alias("n")).toPandas()  # at most one row a piece
        counts = np.exp(prior) * PRIOR
        counts[sums["piece"].to_numpy()] += sums["n"].to_numpy()
        weight = np.log(counts / counts.sum())
    return pieces, weight


def weighed(counted: DataFrame, total: int, ends: int, kinds: int, discount: float, model) -> DataFrame:
    """(word, known, base, lattice, whole) of each word; the last three are log10 of its probabilities in the three models."""
    share = discount * (kinds - (ends > 0)) / total if total else 1.0
    end = (ends + 0.5) / (total + 1)

    def run(batches):
        lattice = None
        for b in batches:
            lattice = lattice or Lattice(model.value[0])
            ws, n = b.column("word").to_pylist(), b.column("n").to_numpy()
            is_end = np.array([w == END for w in ws])
            spelled = lattice.log10([MARK + w for w in ws], model.value[1])
            own = np.where(is_end, math.log10(end), spelled + math.log10(1 - end))
            with np.errstate(divide="ignore"):
                lower = spelled + math.log10(share)
                seen = np.log10(np.maximum(n - discount, 0) / max(total, 1))
                whole = np.where(is_end, math.log10(end), np.logaddexp(seen * math.log(10), lower * math.log(10)) / math.log(10))
            base = np.log10((n + ADDED) / (total + ADDED * (kinds + 1)))
            yield pa.RecordBatch.from_arrays([b.column("word"), *map(pa.array, ((n > 0).astype(float), base, own, whole))], names=["word", *SUMS])

    return counted.mapInArrow(run, "word binary, " + ", ".join(f"{c} double" for c in SUMS))


def scores(docs: DataFrame, training: Column, vocabulary=existing_vocabulary, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, word_score) of each row; scores are log10."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("learn"))
    counted = save(word_counts(docs), "counts")
    # one row: all training tokens, ends, kinds of tokens, words seen once and twice
    word = F.col("word") != F.lit(END)
    total, ends, kinds, once, twice = counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(~word, F.col("n"))), F.lit(0)), F.count_if(F.col("n") > 0), F.count_if(word & (F.col("n") == 1)), F.count_if(word & (F.col("n") == 2))
    ).first()
    discount = min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.9)
    model = spark.sparkContext.broadcast(fit(counted, vocabulary(), rounds if total else 0))
    table = save(weighed(counted, total, ends, kinds, discount, model), "words")
    top = counted.orderBy(F.desc("n"), "word").limit(HEAD).select("word")
    head = table.join(F.broadcast(save(top, "top")), "word").toPandas()  # HEAD rows at most
    known = spark.sparkContext.broadcast((head["word"].map(bytes).tolist(), head[SUMS].to_numpy()))

    def read(batches):
        at, value = {w: i for i, w in enumerate(known.value[0])}, known.value[1]
        for b in batches:
            rows, heads = [], []
            for doc, text, x in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                count = Counter(words(text.as_py()))
                count[END] += 1
                place, often = [], []
                for w, n in count.items():
                    if (i := at.get(w)) is None:
                        rows.append((doc, x, w, n))
                    else:
                        place.append(i)
                        often.append(n)
                sums = (np.array(often, float) @ value[place]).tolist() if place else [0.0] * len(SUMS)
                # the head's sums carry a key of their own, which is no word, so that no key is shared by many rows
                heads.append((doc, x, b" %d" % x, count.total(), *sums))
            docs, xs, ws, ns = zip(*rows, strict=True) if rows else ((), (), (), ())
            doc, own, key, tokens, *sums = zip(*heads, strict=True) if heads else [()] * (4 + len(SUMS))
            none = [None] * len(rows)
            arrays = [pa.array([*docs, *doc], pa.int64()), pa.array([*xs, *own], pa.int64()), pa.array([*ws, *key], pa.binary()), pa.array([*ns, *[None] * len(doc)], pa.int64()), pa.array([*none, *tokens], pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array([*none, *s], pa.float64()) for s in sums)], names=["doc_id", "x", "word", "n", "tokens", *(f"h_{c}" for c in SUMS)])

    held = ", ".join(f"h_{c} double" for c in SUMS)
    parts = docs.select("doc_id", "text", F.xxhash64("text").alias("x")).mapInArrow(read, f"doc_id long, x long, word binary, n long, tokens long, {held}")
    parts = parts.join(table, "word", "left")
    # equal rows are added up, and told apart again by their number
    added = {c: F.sum(F.coalesce(f"h_{c}", F.col("n") * F.col(c))) / F.count("tokens") for c in SUMS}
    out = parts.groupBy("doc_id", "x").agg((F.sum("tokens") / F.count("tokens")).cast("long").alias("n_tokens"), F.count("tokens").alias("rows"), *(c.alias(name) for name, c in added.items()))
    out = out.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return out.select(
        "doc_id", "n_tokens", F.round("known").cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("lattice").alias("score"), F.col("whole").alias("word_score")
    )
