"""Token counts, lattice likelihoods and packing against plain versions."""

import functools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quoteloom.llm import lm, packing, tokencount
from quoteloom.llm.lattice import MARK, Lattice, existing_vocabulary

from .docs import ODD, frame, row

VOCABULARY = existing_vocabulary()


def words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())


def best_count(word):
    """Viterbi from left to right, most likely first, then fewest pieces."""
    word = MARK + word
    best = [(0.0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - 60), end):
            if (piece := word[start:end]) in VOCABULARY:
                best[end] = max(x for x in (best[end], (best[start][0] + VOCABULARY[piece], best[start][1] - 1)) if x is not None)
    return -best[-1][1]


def test_vocabulary_is_a_distribution():
    assert math.isclose(sum(10**w for w in VOCABULARY.values()), 1, rel_tol=1e-9)
    assert all(bytes([b]) in VOCABULARY for b in range(256))


def test_token_counts_equal_brute_force(spark):
    count = functools.cache(best_count)
    got = sorted((r.doc_id or -1, r.n_words, r.n_tokens, r.n_bytes) for r in tokencount.token_counts(frame(spark)).collect())
    want = sorted((r[0] or -1, len(words(r[1])), sum(map(count, words(r[1]))), len((r[1] or "").encode())) for r in ODD)
    assert got == want


def test_token_counts_of_no_documents(spark):
    assert tokencount.token_counts(frame(spark).limit(0)).collect() == []


def test_trie_may_be_dropped(monkeypatch):
    trie = tokencount.CountTrie(VOCABULARY)
    texts = [b"there", b"therefore", b"the", b"other", b"there"]
    want = [trie([t]) for t in texts]
    monkeypatch.setattr(tokencount, "NODES", 3)
    assert [trie([t]) for t in texts] == want == [best_count(t) for t in texts]


def all_segmentations(word, weight):
    """Sum over all ways to cut, one by one."""
    if not word:
        return 1.0
    return sum(10 ** weight[word[:k]] * all_segmentations(word[k:], weight) for k in range(1, len(word) + 1) if word[:k] in weight)


def test_lattice_sums_all_segmentations():
    lattice = Lattice(sorted(VOCABULARY))
    weight = np.array([VOCABULARY[p] for p in lattice.pieces]) * math.log(10)
    some = [b"the", b"\xff\xfe", b"a", b"inter", b"zzz"]
    got = lattice.log10([MARK + w for w in some], weight)
    for w, g in zip(some, got, strict=True):
        assert math.isclose(g, math.log10(all_segmentations(MARK + w, VOCABULARY)) + VOCABULARY[b""], rel_tol=1e-9)
    # each segmentation of a word uses its pieces once: expected lengths add up to the word's
    counts = lattice.expected([MARK + w for w in some], weight)
    assert math.isclose(sum(c * len(p) for c, p in zip(counts, lattice.pieces, strict=True)), sum(len(MARK + w) for w in some), rel_tol=1e-9)
    assert np.isfinite(lattice.log10([MARK + b"q" * 5000], weight)).all()


def text_rows(n=300):
    """Two languages with few words in common."""
    rnd = random.Random(3)
    parts = {"en": "th er in on an re ed nd ha at".split(), "fr": "en es of or nt ea ti to it st".split()}
    word = lambda p: "".join(rnd.choice(p) for _ in range(rnd.choice([1, 1, 2, 2, 3])))
    return [row(i, " ".join(word(parts[lang]) for _ in range(rnd.randrange(1, 120))), lang=lang) for i in range(n) for lang in [rnd.choice(["en", "en", "fr"])]]


def plain_scores(rows, learns):
    """(tokens, known, training tokens, base, score, word score) of each row, word by word in one place."""
    texts = [[w.lower() for w in words(r[1])] + [b"\n"] for r in rows]
    count = Counter(w for r, ws in zip(rows, texts, strict=True) if learns(r[0]) for w in ws)
    n, v = sum(count.values()), len(count)
    lattice = Lattice(sorted(VOCABULARY))
    weight = prior = np.array([VOCABULARY[p] for p in lattice.pieces]) * math.log(10)
    known = [w for w in count if w != b"\n"]
    for _ in range(lm.ROUNDS if n else 0):
        uses = np.exp(prior) * lm.PRIOR + lattice.expected([MARK + w for w in known], weight, np.array([float(count[w]) for w in known]))
        weight = np.log(uses / uses.sum())
    once, twice = (sum(c == k for w, c in count.items() if w != b"\n") for k in (1, 2))
    discount = min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.9)
    every = sorted({w for ws in texts for w in ws})
    spelled = dict(zip(every, lattice.log10([MARK + w for w in every], weight).tolist(), strict=True))
    end = (count[b"\n"] + 0.5) / (n + 1)
    share = discount * len(known) / n if n else 1.0

    def whole(w):
        seen = math.log10(count[w] - discount) - math.log10(n) if count[w] > discount else -math.inf
        top = max(seen, spelled[w] + math.log10(share))
        return top + math.log10(10 ** (seen - top) + 10 ** (spelled[w] + math.log10(share) - top))

    out = Counter()
    for r, ws in zip(rows, texts, strict=True):
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        score = sum(math.log10(end) if w == b"\n" else math.log10(1 - end) + spelled[w] for w in ws)
        words_ = sum(math.log10(end) if w == b"\n" else whole(w) for w in ws)
        out[(r[0] or -1, len(ws), sum(count[w] > 0 for w in ws), n, *(float(f"{x:.9g}") for x in (base, score, words_)))] += 1
    return out


def found_scores(df):
    return Counter((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, *(float(f"{x:.9g}") for x in (r.base_score, r.score, r.word_score))) for r in df.collect())


def close(a, b):
    a, b = sorted(a.elements()), sorted(b.elements())
    return len(a) == len(b) and all(x[:4] == y[:4] and all(math.isclose(p, q, rel_tol=1e-7) for p, q in zip(x[4:], y[4:], strict=True)) for x, y in zip(a, b, strict=True))


def test_lm_equals_plain_version(spark, monkeypatch):
    """Every odd row too: very long words and texts, repeated rows, rows without id, two texts of one id."""
    monkeypatch.setattr(lm, "HEAD", 50)  # so that rarer words go through the join
    rows = [*text_rows(), *ODD, row(12, "another text of this id"), row(12, "er in the end"), row(13, "z" * 3000)]
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    training = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 10 <> 0")
    got = lm.scores(frame(spark, rows), training)
    want = plain_scores(rows, lambda d: d is not None and not held(d))
    assert close(found_scores(got), want)


def test_a_text_s_probability_is_that_of_all_segmentations(spark):
    """One text against the sum over all ways to cut its words, by the weights that the model has."""
    text = "the zzz inter"
    (r,) = lm.scores(frame(spark, [row(1, text)]), F.lit(False)).collect()
    # without training texts the existing weights count
    one = [math.log10(all_segmentations(MARK + w, VOCABULARY)) + VOCABULARY[b""] + math.log10(0.5) for w in text.encode().split()]
    assert math.isclose(r.score, sum(one) + math.log10(0.5), rel_tol=1e-6)


def test_lm_learns_the_pieces(spark):
    """Fitted to the training texts, the lattice gives held-out ones more than the existing weights do."""
    rows = text_rows()
    training = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 10 <> 0")
    before = {r.doc_id: r.score for r in lm.scores(frame(spark, rows), F.lit(False)).collect()}
    after = {r.doc_id: r.score for r in lm.scores(frame(spark, rows), training).collect()}
    held = [d for d in before if zlib.crc32(str(d).encode()) % 10 == 0]
    assert all(after[d] > before[d] for d in held)


def test_lm_odd_rows(spark):
    rows = lm.scores(frame(spark), F.lit(False)).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(ODD) and got[1].n_tokens == got[2].n_tokens == got[3].n_tokens == 1 and got[6].n_tokens == 9 and got[4].n_tokens == 40001
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) and math.isfinite(r.base_score) and math.isfinite(r.word_score) for r in rows)
    assert lm.scores(frame(spark, []), F.lit(True)).count() == 0


def plain_ids():
    coding = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: coding.encode(text or "", add_special_tokens=False).ids + [packing.END]


def test_packing_is_a_partition_of_all_tokens(spark):
    rows = [*ODD, *text_rows(200), row(500, "some words " * 2000)]
    got = packing.pack(frame(spark, rows)).collect()
    ids, want = plain_ids(), Counter()
    for d, text, *_ in rows:
        own = np.array(ids(text), "<u4")
        first = len(own) % 1024 or min(len(own), 1024)
        for piece, (a, b) in enumerate(zip([0, *range(first, len(own), 1024)], [*range(first, len(own) + 1, 1024)], strict=True)):
            want[d, piece, a, b - a, zlib.crc32(own[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= math.ceil(sum(r.length for r in got) / 1024) * 1.05 + 1
    assert packing.pack(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(60))
def test_plan_uses_up_all_counts(seed):
    rnd = random.Random(seed)
    limit = rnd.choice([8, 16, 64, 1024])
    counts = {rnd.randrange(1, limit + 1): rnd.randrange(1, rnd.choice([3, 50, 5000])) for _ in range(rnd.randrange(0, rnd.choice([4, 40, limit])))}
    runs = packing.plan(counts, limit)
    used = Counter()
    for members, times in runs:
        assert times > 0 and sum(members) <= limit
        for x in members:
            used[x] += times
    assert used == Counter(counts)
    long = sum(n for k, n in counts.items() if 2 * k > limit)
    least = max(long, math.ceil(sum(k * n for k, n in counts.items()) / limit))
    assert sum(t for _, t in runs) <= 4 / 3 * least + 1


def test_exact_complements_are_found():
    assert sum(t for _, t in packing.plan({1000: 5, 24: 5})) == 5
    assert sum(t for _, t in packing.plan({1000: 5, 20: 5, 4: 5})) == 5
    assert sum(t for _, t in packing.plan({1000: 5, 15: 5, 7: 5, 2: 5})) == 5
    assert sum(t for _, t in packing.plan({512: 7})) == 4


def test_equal_pieces_are_spread_over_ranges(spark):
    """Rows without doc_id, and rows of one doc_id, are numbered in many ranges."""
    for doc in ("null", "7"):
        rows = spark.range(0, 100_000, 1, 8).selectExpr(f"cast({doc} as long) as doc_id", "0 as piece", "5L as ids_crc32", "50 as ranges").withColumn("own", F.monotonically_increasing_id())
        counts = [r["count"] for r in packing.in_ranges(rows).groupBy("range").count().collect()]
        assert len(counts) == 50 and max(counts) < 2 * min(counts)


def test_packing_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE", 100)
    got = packing.pack(frame(spark, [row(None, "the same text")] * 700 + [row(5, "the same text")] * 300), limit=16).collect()
    assert len(got) == 1000 and len({(r.sequence_id, r.offset) for r in got}) == 1000
    assert len({r.sequence_id for r in got}) == -(-1000 // (16 // got[0].length))
