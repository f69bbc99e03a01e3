"""Unigram token counts of documents by dynamic programming over a trie of distinct pre-tokens.

A pre-token is a word with the vocabulary's mark in front; its tokens are the pieces of its most likely segmentation
under the existing weights (of equally likely ones, the one with fewer pieces).  A worker inserts the pre-tokens that
it has not met into a trie.  A node's forward score, the best one of its prefix, is computed once, when the node is
made, from the scores of the nodes above it; all words that share the prefix share it.  A word's last node stores its
count, so a recurring word costs one look-up.  The trie is dropped and begun anew at a bound on its nodes.  Nothing is
shuffled or gathered.

Edge cases: null and empty texts have no words and no tokens; bytes outside the vocabulary are pieces of their own;
repeated rows are counted each; other columns are ignored; words keep their case.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lattice import MARK, existing_vocabulary

NODES = 1_000_000
COUNTS = "doc_id long, n_bytes long, n_words long, n_tokens long"


class CountTrie:
    def __init__(self, vocabulary: dict[bytes, float]) -> None:
        self.weights = {p: w for p, w in vocabulary.items() if p}
        self.longest = max(map(len, self.weights))
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.best = [(0.0, 0)]  # of each node: score, minus the number of pieces
        self.terminal: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        """Inserts a pre-token and returns its number of tokens."""
        path, at = [0], 0
        for depth in range(1, len(word) + 1):
            key = at << 8 | word[depth - 1]
            at = self.children.get(key, 0)
            if not at:
                best, weights, least = self.best, self.weights, None
                for k in range(1, min(depth, self.longest) + 1):
                    w = weights.get(word[depth - k : depth])
                    if w is not None:
                        above = best[path[depth - k]]
                        score = (above[0] + w, above[1] - 1)
                        if least is None or score > least:
                            least = score
                at = self.children[key] = len(best)
                best.append(least)
            path.append(at)
        return -self.best[at][1]

    def __call__(self, words: list[bytes]) -> int:
        if len(self.best) > NODES:
            self.clear()
        terminal, total = self.terminal, 0
        for w in words:
            n = terminal.get(w)
            if n is None:
                n = terminal[w] = self.count(MARK + w)
            total += n
        return total


def token_counts(docs: DataFrame, vocabulary=existing_vocabulary) -> DataFrame:
    """COUNTS of each row."""

    def run(batches):
        count = CountTrie(vocabulary())
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                ws = raw.split()
                rows.append((doc, len(raw), len(ws), count(ws)))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in COUNTS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, COUNTS)
