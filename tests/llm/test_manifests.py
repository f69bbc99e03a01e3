"""Token files and Merkle manifests against plain versions."""

import random
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quoteloom.llm import merkle, tokenfile

from .docs import ODD, frame, row

WHOLE = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
HOSTILE = ["ΟΔΟΣ Σ ΑΣ.", "a ́x x\x1cy\x85z\xa0w", "<|endoftext|>ab<|startoftext|> <|endof text|>", "It's 'S THEY'RE 't 'll ’s", "İstanbul ǅ ŒŸ", "が が 日本語", "12a1!!!...??~}", "\x00a b\x0bc\x0cd", "👩‍👩‍👧 🇩🇪", "x" * 3000, "ç" * 200 + " " + "!" * 100]


def whole_ids(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("span", [0, 3, 1000, 10**9, 2**63 - 1, 2**64 - 1])
@pytest.mark.parametrize("n", [1, 2, 700, 9000])
def test_elias_fano(span, n):
    r = random.Random(n)
    first = -(2**63) if span >= 2**63 else -5
    values = np.array(sorted([first, first + span, *(first + r.randint(0, span) for _ in range(n))][: n + 1]), np.int64)
    data = tokenfile.EliasFano.of(values)
    code = tokenfile.EliasFano(data)
    assert code.select(np.arange(len(values))).tolist() == values.tolist()
    some = np.array([r.randrange(len(values)) for _ in range(50)])
    assert code.select(some).tolist() == values[some].tolist()
    if n == 9000:  # near the bound for such a sequence, directory included
        assert 8 * len(data) / n < 2.3 + max(0, np.log2(max(span, 1) / n)) + 1
    assert tokenfile.EliasFano(tokenfile.EliasFano.of(np.array([], np.int64))).n == 0


def test_words_are_encoded_as_in_whole_texts():
    r = random.Random(5)
    letters = [*"aAbσΣ's \t\n\x0b\x1c\x85\xa0é1.!<|>日'-;", "̣", "ͅ", "<|endoftext|>", "'re"]
    texts = HOSTILE + [t[1] for t in ODD] + ["".join(r.choice(letters) for _ in range(r.randrange(20))) for _ in range(3000)]
    encode = tokenfile.Encoder("word_bpe_49k.json")
    for text in texts:
        assert np.frombuffer(encode(text), "<u2").tolist() == whole_ids(text)[:-1]


def brute_tokens(docs):
    out, start = [], 0
    ids = [(d, len((t or "").encode()), whole_ids(t)) for d, t in docs]  # no two texts of one id and size here
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    for d, _, x in sorted(ids, key=lambda e: (e[0] is not None, e[0] or 0, e[1])):
        out.append((d, start, len(x), crc(x)))
        start += len(x)
    return out


def by_start(df):
    return sorted((tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])


@pytest.mark.parametrize("file_bytes", [100, tokenfile.FILE])
def test_token_files_hold_what_was_written(spark, file_bytes):
    rows = ODD + [row(20 + i, t) for i, t in enumerate(HOSTILE)] + [row(-(2**62), "far"), row(None, "b"), row(2**62, "away")]
    assert by_start(tokenfile.round_trip(frame(spark, rows), file_bytes=file_bytes)) == brute_tokens([(r[0], r[1]) for r in rows])


def test_repeated_rows_are_spread(spark, tmp_path):
    rows = [row(7, "the same text")] * 400
    path = f"file://{tmp_path}/ids"
    tokenfile.write_token_files(frame(spark, rows), path)
    assert spark.read.format("binaryFile").load(path).where("length > 0").count() > 1  # one id, many ranges
    assert by_start(tokenfile.read_token_files(spark, path)) == brute_tokens([(7, "the same text")] * 400)


def test_no_token_files_of_no_documents(spark):
    assert tokenfile.round_trip(frame(spark).limit(0)).collect() == []


def test_damaged_token_file_is_refused():
    data = tokenfile.token_file(0, 0, [(None, b"\1\0"), (5, b"\2\0\1\0")], 2) + b"\0"
    f = tokenfile.TokenFile(data)
    assert f.doc_ids(np.arange(2)) == [None, 5] and [x.tolist() for x in f.bounds(np.array([1, 0]))] == [[1, 0], [3, 1]]
    for bad in (data[:-9] + b"\7" + data[-8:], data[:20], b""):
        with pytest.raises(ValueError, match="whole file"):
            tokenfile.TokenFile(bad)


# --- Merkle ---------------------------------------------------------------------------------------------------------


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(d, claimed=False):
    fields = [d["doc_id"], d["source"], d["lang"], d["n_chars"], d["text"]]
    if claimed and d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 7 == 0 and d["n_chars"] is not None:
        fields[3] += 1
    return digest(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree(nodes):
    """Levels, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def route(levels, at):
    """(sibling or None, whether it comes first) from a leaf on."""
    out = []
    for level in levels[:-1]:
        out.append((level[at ^ 1] if at ^ 1 < len(level) else None, at & 1))
        at >>= 1
    return out


def brute_manifest(docs):
    groups = {}
    for d in docs:
        groups.setdefault(d["lang"], []).append(d)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for members in groups.values():
        members.sort(key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, leaf(d)))
    trees = {g: tree([leaf(d) for d in groups[g]]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for n, g in enumerate(names):
        for at, d in enumerate(groups[g]):
            steps = route(trees[g], at) + route(top, n)
            node = leaf(d, claimed=True)
            for sibling, first in steps:
                node = digest(node) if sibling is None else digest(sibling, node) if first else digest(node, sibling)
            proof = digest(*(s for s, _ in steps if s))
            out.append((d["doc_id"], leaf(d), trees[g][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


@pytest.mark.parametrize("height", range(12))
def test_layout_is_van_emde_boas(height):
    lay = merkle.Layout(height)
    assert sorted(np.concatenate(lay.at).tolist()) == list(range(2 ** (height + 1) - 1))

    def order(depth, number, levels):
        """The definition: the upper half, then each lower part."""
        if levels == 1:
            return [(depth, number)]
        half = levels // 2
        out = order(depth, number, half)
        for j in range(2**half):
            out += order(depth + half, (number << half) + j, levels - half)
        return out

    assert [int(lay.at[d][j]) for d, j in order(0, 0, height + 1)] == list(range(lay.size))


@pytest.mark.parametrize("leaves", [1, 2, 3, 5, 8, 13, 16])
def test_block_paths_lead_to_its_root(leaves):
    digests = [sha256(bytes([i])).digest() for i in range(leaves)]
    lay = merkle.Layout(4)
    nodes = lay.build(digests)
    for j, d in enumerate(digests):
        assert merkle.fold(d.hex(), lay.path(nodes, leaves, j)) == nodes[:32].hex()


def claim():
    tampered = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 7 = 0")
    return {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}


def audited(docs, height):
    made = merkle.manifest(docs, claims=claim(), height=height)
    found = merkle.proofs(made).select(F.col("id").alias("doc_id"), "leaf", "subroot", F.lit(made.root).alias("root"), "proof_sha256", "folded_root")
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("height", [1, 2, merkle.HEIGHT])
def test_manifest_equals_brute_force(spark, height):
    r = random.Random(3)
    rows = [(r.randrange(200) if r.random() < 0.95 else None, r.choice(["a", "ü", None]), r.choice([None, "", "de", "en", "en", "zh", "é"]), r.choice([None, 5, -7]), r.choice([None, "", "text", "ünï"])) for _ in range(150)]
    rows += rows[:20] + [(1, "s", "only", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = audited(docs, height).collect()
    assert plain(got) == plain(brute_manifest([d.asDict() for d in docs.collect()]))
    assert {x.verified for x in got} == {True, False}


def test_manifest_of_odd_documents(spark):
    docs = frame(spark)
    assert plain(merkle.audit(docs, claim()).collect()) == plain(brute_manifest([d.asDict() for d in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]))
    one = frame(spark, [row(3, "alone")])
    (got,) = merkle.audit(one, claim()).collect()
    assert got.leaf == got.subroot == got.root and got.proof_sha256 == digest()
    assert merkle.audit(frame(spark).limit(0), claim()).collect() == []
