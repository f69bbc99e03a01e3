"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard check, connected components.

Signature.  Shingle hashes live in Z(2^32).  A first permutation scatters them; a second one, shifted circularly by
k, gives coordinate k: ``min over x of pi((sigma(x) + k * STEP) mod 2^32)``.  Two permutations serve all coordinates.

Candidates.  Coordinates are cut into bands; documents that share a band share a bucket.  No bucket is expanded into
its pairs.  Every member is compared with the bucket's smallest one.  Buckets whose members are then still in several
components go on: inside blocks of bounded size, likely links between components are checked one member against many
at a time, and only the links that join components come out.  The members of a bucket's largest component are dealt out among
its blocks, and the others go to each of them, as long as those others are no more than a block.

Buckets with more others than that hold families of documents below the threshold, and blocks of theirs would meet two by two.
Their members meet by prefixes instead: shingles have one order, those that few members hold first; of two sets at the threshold the
smaller one has a shingle among its first ``n - 2tn / (1 + t) + 1`` that is among the first ``n - tn + 1`` of the larger.  So members
meet under rare shingles, what a family has in common leads to nothing, and no pair at the threshold is passed over.
The order comes from counts by a hash of the shingle, SKETCH of them whatever the number of documents; any order gives the same links.

Check.  Links are confirmed on the full shingle sets, made again from the texts of those that share a bucket.
Documents with equal sets are one class throughout.

Edge cases: null, empty and blank texts have no shingles and are linked with nothing; a text with fewer words than
``width`` is one shingle; rows without doc_id have no result; repeated rows of one doc_id count once; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, WordHashes, fresh, save, shingles, words

BANDS, ROWS = 24, 4
#: Odd shift between coordinates of the second permutation.
STEP = 0x3C6EF373
#: Shingles and members to a block of a bucket, about.
BLOCK, MEMBERS = 500_000, 1024
#: Counts of shingles, by hash, that their order comes from.
SKETCH = 2**19
#: Shingles handled at once, so that the work array stays in cache whatever the text's length.
CHUNK = 2048

FEATURES = "doc_id long, n_shingles long, set_hi long, set_lo long, bands array<long>, sig binary"


def permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A bijection on 32-bit integers (odd multipliers and xor-shifts), in place."""
    for mul, shift in ((a, 16), (b, 13)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(mul)
    x ^= x >> np.uint32(16)
    return x


def signature(hashes: np.ndarray) -> np.ndarray:
    """BANDS * ROWS circulant MinHash coordinates of a non-empty set of 64-bit hashes."""
    sigma = permute((hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35)
    shifts = (np.arange(BANDS * ROWS, dtype=np.uint64) * np.uint64(STEP)).astype(np.uint32)[:, None]
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(sigma), CHUNK):
        np.minimum(out, permute(sigma[None, i : i + CHUNK] + shifts, 0x7FEB352D, 0x846CA68B).min(axis=1), out=out)
    return out


def features(docs: DataFrame, width: int) -> DataFrame:
    """FEATURES of each document; bands are null where there are no shingles."""

    def run(batches):
        cache = WordHashes()
        for b in batches:
            rows: list = [[] for _ in range(6)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles(cache.of(words(text)), width)
                row = [doc, len(s), None, None, None, None]
                if len(s):
                    digest = xxhash.xxh3_128_digest(s.tobytes())
                    sig = signature(s)
                    bands = [
                        int.from_bytes(xxhash.xxh3_64_digest(sig[i : i + ROWS].tobytes(), seed=i), "big", signed=True)
                        for i in range(0, len(sig), ROWS)
                    ]
                    row[2:] = (
                        int.from_bytes(digest[:8], "big", signed=True),
                        int.from_bytes(digest[8:], "big", signed=True),
                        bands,
                        sig.astype(np.uint8).tobytes(),
                    )
                for column, value in zip(rows, row, strict=True):
                    column.append(value)
            types = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=[f.split()[0] for f in FEATURES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").mapInArrow(run, FEATURES)


def least_match(percent: int) -> int:
    """Equal signature bytes that a pair at the threshold has but for five standard deviations."""
    k, t = BANDS * ROWS, percent / 100
    return math.floor(k * t - 5 * math.sqrt(k * t * (1 - t)))


def likely(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose set sizes allow a link (exact) and whose signatures make one likely."""
    least = least_match(percent)
    left = sigs.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    right = sigs.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("sa", "sb"))
                yield b.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those pairs (a, b) for which 100 * |intersection| >= percent * |union| on the full shingle sets."""
    moved = pairs.join(texts.withColumnsRenamed({"rep": "b", "text": "tb"}).hint("merge"), "b")
    both = moved.join(texts.withColumnsRenamed({"rep": "a", "text": "ta"}).hint("merge"), "a").select("a", "b", "ta", "tb")

    def run(batches):
        cache, last, own = WordHashes(), None, None
        for batch in batches:
            keep = []
            for a, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "ta", "tb")), strict=True):
                if a != last:
                    last, own = a, shingles(cache.of(words(ta)), width)
                other = shingles(cache.of(words(tb)), width)
                common = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * common >= percent * (len(own) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """labels(node, comp), with comp lowered to the smallest one reachable over edges(a, b).

    Hash-to-min over contracted labels: each round links every label to the smallest label next to it and then
    follows the links (pointer jumping), so the number of rounds grows with the logarithm of the diameter.
    Each round is a written table."""
    la, lb = (labels.select(F.col("node").alias(c), F.col("comp").alias("l" + c)) for c in "ab")
    links = edges.join(la, "a").join(lb, "b").where("la <> lb").select(F.col("la").alias("u"), F.col("lb").alias("v"))
    links = save(links.union(links.select("v", "u")).distinct(), "links")
    parent = None  # (u, p): p < u, of labels that are no longer roots
    while not links.isEmpty():
        step = save(links.groupBy("u").agg(F.min("v").alias("p")).where("p < u"), "parent")
        while True:  # follow parents to their roots
            up = step.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            jumped = save(step.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")), "jump")
            step = jumped.select("u", "p")
            if jumped.where("moved").isEmpty():
                break
        if parent is None:
            parent = step
        else:
            now = step.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            parent = save(parent.join(now, "p", "left").select("u", F.coalesce("pp", "p").alias("p")).union(step), "parents")
        pu = step.select("u", F.col("p").alias("pu"))
        pv = step.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        links = links.join(pu, "u", "left").join(pv, "v", "left").select(F.coalesce("pu", "u").alias("u"), F.coalesce("pv", "v").alias("v"))
        links = save(links.where("u <> v").distinct(), "links")
    if parent is None:
        return labels
    root = parent.select(F.col("u").alias("comp"), "p")
    return save(labels.join(root, "comp", "left").select("node", F.coalesce("p", "comp").alias("comp")), "labels")


def _likely(n: np.ndarray, sig: np.ndarray, i: int, percent: int, least: int) -> np.ndarray:
    """Which later members of a block may be linked with member i, by set size and signature."""
    near = 100 * np.minimum(n[i], n[i + 1 :]) >= percent * np.maximum(n[i], n[i + 1 :])
    return near & ((sig[i + 1 :] == sig[i]).sum(axis=1) >= least)


def involved(blocks: DataFrame, percent: int) -> DataFrame:
    """(gid, rep) of the members that have a likely link to another component in their block."""
    groups = blocks.groupBy("gid").agg(F.collect_list(F.struct("rep", "n", "comp", "sig")).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    least = least_match(percent)

    def run(batches):
        for batch in batches:
            out_gid, out_rep = [], []
            for r in range(batch.num_rows):
                gid, rep, n, comp, sig = (c[r].as_py() for c in batch.columns)
                n, comp, sig = np.array(n), np.array(comp), np.frombuffer(b"".join(sig), np.uint8).reshape(len(rep), -1)
                hit = np.zeros(len(rep), bool)
                for i in range(len(rep) - 1):
                    found = _likely(n, sig, i, percent, least) & (comp[i + 1 :] != comp[i])
                    hit[i] |= found.any()
                    hit[i + 1 :] |= found
                out_rep += [rep[i] for i in np.flatnonzero(hit)]
                out_gid += [gid] * int(hit.sum())
            yield pa.RecordBatch.from_arrays([pa.array(out_gid, pa.int64()), pa.array(out_rep, pa.int64())], names=["gid", "rep"])

    return groups.where("lo <> hi").selectExpr("gid", "m.rep", "m.n", "m.comp", "m.sig").mapInArrow(run, "gid long, rep long")


def block_links(members: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that join components within blocks; members: (gid, rep, n, comp, sig, text).

    Every likely pair of a block that is not joined yet is checked on the full sets; only joining links come out."""
    groups = members.groupBy("gid").agg(F.collect_list(F.struct("rep", "n", "comp", "sig", "text")).alias("m"))
    least = least_match(percent)

    def links(cache, rep, n, comp, sig, text):
        order = np.argsort(rep)
        rep, n = np.array(rep)[order], np.array(n)[order]
        sig = np.frombuffer(b"".join(sig), np.uint8).reshape(len(rep), -1)[order]
        root = dict(zip(comp, comp, strict=True))
        own = [comp[i] for i in order]

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        sets = [shingles(cache.of(words(text[i])), width) for i in order]
        code = np.unique(np.concatenate(sets), return_inverse=True)[1]  # shingles numbered within the block
        ends = np.cumsum([len(s) for s in sets])
        codes = np.split(code, ends[:-1])
        mine = np.zeros(len(code) and int(code.max()) + 1, bool)
        for i in range(len(rep) - 1):
            other = np.flatnonzero(_likely(n, sig, i, percent, least)) + i + 1
            here = find(own[i])
            other = [j for j in other.tolist() if find(own[j]) != here]
            if not other:
                continue
            mine[codes[i]] = True
            common = np.add.reduceat(mine[np.concatenate([codes[j] for j in other])].astype(np.int64), np.cumsum([0, *(len(codes[j]) for j in other[:-1])]))
            mine[codes[i]] = False
            for j, c in zip(other, common.tolist(), strict=True):
                if 100 * c >= percent * (len(codes[i]) + len(codes[j]) - c) and (a := find(own[i])) != (b := find(own[j])):
                    root[a] = b
                    yield int(rep[i]), int(rep[j])

    def run(batches):
        cache = WordHashes()
        for batch in batches:
            for r in range(batch.num_rows):
                out = list(links(cache, *(c[r].as_py() for c in batch.columns)))
                columns = zip(*out, strict=True) if out else [[]] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    return groups.selectExpr("m.rep", "m.n", "m.comp", "m.sig", "m.text").mapInArrow(run, "a long, b long")


def unsettled(members: DataFrame) -> DataFrame:
    """The gid of groups that hold several components; one for each set of members.  members: (gid, rep, n, comp)."""
    code = [F.min("rep"), F.max("rep"), F.count("*"), F.bit_xor(F.xxhash64("rep")), F.bit_xor(F.xxhash64(F.lit(1), "rep"))]
    groups = members.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.struct(*code).alias("code"))
    return groups.where("lo <> hi").groupBy("code").agg(F.min("gid").alias("gid")).select("gid")


def residual(shared: DataFrame, sizes: DataFrame, of: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(gid, rep): blocks of members of buckets that hold several components.

    shared: (bucket, rep, ...); sizes: (rep, n); of: (rep, comp)."""
    mixed = shared.join(of, "rep").groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    members = shared.select("bucket", "rep").join(save(mixed, "mixed"), "bucket").join(sizes, "rep").join(of, "rep")
    groups = save(members.select(F.col("bucket").alias("gid"), "rep", "n", "comp"), "groups")
    rows = groups.join(save(unsettled(groups), "unsettled"), "gid")
    each = rows.groupBy("gid", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("h"))
    each = each.groupBy("gid").agg(F.max(F.struct("c", "comp", "h")).alias("m"), F.sum("c").alias("size"), F.sum("h").alias("held"))
    others = parts(F.col("size") - F.col("m.c"), F.col("held") - F.col("m.h"))
    largest = each.select("gid", F.col("m.comp").alias("largest"), parts(F.col("m.c"), F.col("m.h")).alias("p"), (others > 1).alias("many"))
    rows = save(rows.join(save(largest, "largest"), "gid"), "rows")
    inner = F.col("comp") == F.col("largest")
    a = rows.where(~F.col("many") & inner).select(block("gid", own("p")).alias("gid"), "rep")
    b = rows.where(~F.col("many") & ~inner).select("gid", "rep", upto("p")).select(block("gid", "other").alias("gid"), "rep")
    return a.union(b).union(prefixed(rows.where("many").select("rep", "n", "comp").distinct(), texts, width, percent)).distinct()


def parts(size: Column, held: Column) -> Column:
    """Parts of members that are a block at most."""
    return F.ceil(F.greatest(size / MEMBERS, held / BLOCK)).cast("int")


def own(n: str) -> Column:
    return F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")


def upto(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("other")


def block(*numbers: Column | str) -> Column:
    return F.xxhash64(*numbers)


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """Shingles of a set of n, in the common order, one of which it shares with any set at the threshold that is not smaller; not larger."""
    return n - -(-2 * percent * n // (100 + percent)) + 1, n - -(-percent * n // 100) + 1


def prefixed(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(gid, rep): blocks in which all members that may be linked meet, by the prefixes of their sets; members: (rep, n, comp)."""

    def sets(batches):
        cache = WordHashes()
        for b in batches:
            s = [shingles(cache.of(words(t)), width).view(np.int64) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(s, pa.list_(pa.int64()))], names=["rep", "n", "comp", "s"])

    made = save(members.join(texts.hint("merge"), "rep").select("rep", "n", "comp", "text").mapInArrow(sets, "rep long, n long, comp long, s array<long>"), "sets")
    place = F.explode(F.transform("s", lambda x: x.bitwiseAND(F.lit(SKETCH - 1)))).alias("place")
    counted = made.select(place).groupBy("place").agg(F.count("*").alias("c")).toPandas()  # SKETCH rows at most
    counts = np.zeros(SKETCH, np.int64)
    counts[counted["place"].to_numpy(np.int64)] = counted["c"].to_numpy(np.int64)
    counts = made.sparkSession.sparkContext.broadcast(counts)

    def prefixes(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for rep, n, comp, s in zip(*(c.to_pylist() for c in b.columns[:3]), b.column(3), strict=True):
                s = s.values.to_numpy()
                smaller, larger = prefix_lengths(len(s), percent)
                first = s[np.lexsort((s, counts.value[s & (SKETCH - 1)]))[:larger]]
                for column, value in zip(out, ([rep] * larger, [n] * larger, [comp] * larger, first.tolist(), [i < smaller for i in range(larger)]), strict=True):
                    column += value
            types = [pa.int64()] * 4 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["rep", "n", "comp", "token", "smaller"])

    rows = save(made.mapInArrow(prefixes, "rep long, n long, comp long, token long, smaller boolean"), "prefixes")
    small = F.col("smaller")
    groups = rows.groupBy("token").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), parts(F.count("*"), F.sum("n")).alias("l"), parts(F.count_if(small), F.sum(F.when(small, F.col("n")).otherwise(0))).alias("s")
    )
    # a larger set meets smaller ones only, so a shingle that is no smaller set's is none's
    groups = save(groups.where("lo <> hi and s > 0").select("token", "l", "s"), "tokens")
    met = rows.join(groups, "token")
    as_smaller = met.where(small).select("token", "rep", own("s").alias("own"), upto("l")).select(block("token", "own", "other").alias("gid"), "rep")
    as_larger = met.select("token", "rep", own("l").alias("own"), upto("s")).select(block("token", "other", "own").alias("gid"), "rep")
    return as_smaller.union(as_larger)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every doc_id; see the module's text for the method."""
    feats = save(features(docs, width), "features")
    full = feats.where("n_shingles > 0")
    # one class for each distinct set; its representative is the smallest doc_id
    reps = full.groupBy("set_hi", "set_lo").agg(F.min_by(F.struct(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "bands", "sig"), "doc_id").alias("r"))
    reps = save(reps.select("set_hi", "set_lo", "r.*"), "classes")
    buckets = reps.select(F.explode("bands").alias("bucket"), "rep", "n")
    heads = buckets.groupBy("bucket").agg(F.min("rep").alias("head"), F.count("*").alias("size"), F.sum("n").alias("held")).where("size > 1")
    # written first, so that the join deals its sides itself and a hot bucket can be split
    shared = save(buckets.drop("n").join(save(heads, "heads"), "bucket"), "buckets")
    nodes = save(shared.select("rep").distinct(), "nodes")
    # the texts of all that share a bucket; a shuffle at any size
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").hint("merge").join(nodes, "rep", "left_semi")
    texts = save(texts, "texts")
    sigs = reps.select("rep", "n", "sig")
    pairs = shared.where("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = save(likely(pairs, sigs, percent), "pairs")
    labels = nodes.select(F.col("rep").alias("node"), F.col("rep").alias("comp"))
    labels = components(save(confirm(pairs, texts, width, percent), "edges"), labels)

    of = labels.withColumnRenamed("node", "rep")
    blocks = save(residual(shared, reps.select("rep", "n"), of, texts, width, percent).join(sigs, "rep").join(of, "rep"), "blocks")
    some = save(involved(blocks, percent), "involved")
    members = blocks.join(some, ["gid", "rep"], "left_semi").join(texts.hint("merge"), "rep")
    labels = components(save(block_links(members, width, percent), "edges"), labels)
    of = labels.withColumnRenamed("node", "rep")

    member = full.select("doc_id", "set_hi", "set_lo").join(reps.select("set_hi", "set_lo", "rep"), ["set_hi", "set_lo"])
    member = member.join(of, "rep", "left").select("doc_id", F.coalesce("comp", "rep").alias("component_id"))
    out = feats.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles")).join(member.groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that have a smaller near-duplicate; rows without doc_id stay."""
    (name,) = fresh(docs, "gone")
    gone = near_duplicates(docs, width, percent).where("not kept").select(F.col("doc_id").alias(name))
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: For width 3 and 85 percent: all pairs that share a shingle, and all that can be reached.  Feasible on small tables.
ORACLE = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{WORD}') as ws from documents where doc_id is not null),
sh as (select distinct doc_id, unnest(case when len(ws) < 3 then case when len(ws) = 0 then [] else [array_to_string(ws, ' ')] end
       else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end) as s from w),
size as (select doc_id, count(*) as n from sh group by 1),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from common join size x on x.doc_id = a join size y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
edge as (select a, b from link union all select b, a from link),
reach as (select a, b from edge union select r.a, e.b from reach r join edge e on r.b = e.a),
comp as (select a as doc_id, min(b) as low from reach group by 1)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) as component_id, d.doc_id <= coalesce(low, d.doc_id) as kept
from (select distinct doc_id from w) d left join size using (doc_id) left join comp using (doc_id)
"""
