"""Line dedup, mixing, toxicity, top-k and the pipeline against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quoteloom.llm import linededup, mixing, topk, toxicity

from .docs import ODD, SCHEMA, frame, row

# --- line dedup


def template(line):
    tokens = re.findall(r"[^\x20\x09-\x0d]+", line)
    masked = ["<*>" if re.search("[0-9]", t) else t for t in tokens]
    return tuple(masked if 2 * masked.count("<*>") <= len(tokens) else tokens)


def plain_dedup(rows, often=10):
    """Line by line and pair by pair: (kept rows, number of templates that joined an earlier one)."""
    at, place = defaultdict(set), {}
    for d, text, *_ in rows:
        if d is not None:
            for i, line in enumerate((text or "").split("\n")):
                if t := template(line):
                    at[t].add(d)
                    place[t] = min(place.get(t, (d, i)), (d, i))
    buckets = defaultdict(list)
    for t in at:
        k = min(6, len(t) // 4) if len(t) >= 8 else 0
        for j in range(k):
            buckets[len(t), t[:2], j, t[j * len(t) // k : (j + 1) * len(t) // k]].append(t)
    keep, joined = {}, set()
    for t, ds in at.items():
        long = len(t) >= 8 or len(" ".join(t)) >= 40
        if len(ds) > 1 and (long or len(ds) >= often):
            keep[t] = min(ds)
    for members in buckets.values():
        head = min(members, key=place.get)
        for t in members:
            if t != head and 5 * sum(a == b for a, b in zip(t, head, strict=True)) >= 4 * len(t):
                keep[t] = min(keep.get(t, min(at[t])), place[head][0])
                joined.add(t)
    drop = lambda d, t: t in keep and d > keep[t]
    return Counter((d, text if text is None or d is None else "\n".join(x for x in text.split("\n") if not drop(d, template(x)))) for d, text, *_ in rows), len(joined)


def line_rows():
    rnd = random.Random(5)
    word = lambda: rnd.choice("abcdefgh") + rnd.choice("xyz")
    shared = [" ".join(word() for _ in range(n)) for n in (1, 2, 3, 4, 7, 8, 9, 60, 90)]
    rows = list(ODD)

    def edited(line):  # some words changed, none with a digit
        ws = line.split()
        for _ in range(rnd.randrange(0, max(1, len(ws) // 4))):
            ws[rnd.randrange(len(ws))] = word() + word()
        return " ".join(ws)

    for i in range(100, 150):
        lines = [" ".join(word() for _ in range(rnd.randrange(0, 12))) for _ in range(6)]
        lines += [rnd.choice(shared), f"Page {i} of {i * 2} printed on day {i} by nobody known", f"{i} {i} {i} {i} {i} {i} {i} {i + 1}", " ".join(rnd.choice(shared).split()).replace(" ", " \t "), edited(rnd.choice(shared)), edited(shared[-1])]
        lines += [f"Dear {word()}{word()}, your parcel has left our house in {word()} today", "文" * 45 if i % 7 == 0 else "文" * 20 + "x" * (i % 3)]
        rnd.shuffle(lines)
        rows.append(row(i, "\n".join(lines)))
    rows += [row(7, "another text of this doc_id\nPage 5 of 6 printed on day 7 by nobody known"), row(7, None), row(160, "\n".join(["Page 1 of 2 printed on day 3 by nobody known"] * 3000 + ["the end"]))]
    return rows


@pytest.mark.parametrize("often", [10, 2])
def test_line_dedup_equals_brute_force(spark, often):
    rows = line_rows()
    want, joined = plain_dedup(rows, often)
    assert joined > 25
    if often == 10:
        got = linededup.drop_recurring_lines(frame(spark, rows)).persist()
        assert got.columns == frame(spark).columns
    else:
        got = linededup.report(frame(spark, rows), often).persist()
        assert got.agg(F.sum("n_dropped")).first()[0] > 3000 and got.where("n_dropped > n_lines").isEmpty()
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want
    assert linededup.report(frame(spark, [])).count() == 0


def test_fields_without_digits(spark):
    """Names are fields: of lines that differ in one word the first document's stays."""
    line = "Your parcel for {} has left our house in Lyon today"
    rows = [row(i, f"own text number {i} here\n{line.format(name)}") for i, name in enumerate(["Ada", "Bo", "Cy"])] + [row(9, line.format("Ada").replace("Lyon", "Rome").replace("left", "reached").replace("house", "town"))]
    got = {r.doc_id: r.n_dropped for r in linededup.report(frame(spark, rows)).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 9: 0}


# --- mixing


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, capped, total = {}, {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        rest, w = total - sum(capped.values()), sum(weight[s] for s in free)
        target = capped | {s: rest * weight[s] / w for s in free}
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            return target
        capped |= {s: 3 * sizes[s] for s in over}


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 20)
    rnd = random.Random(2)
    rows = ODD + [row(i, "w " * rnd.randrange(0, 40), rnd.choice(["hot"] * 9 + ["b", "c", "Z", "é"])) for i in range(100, 1200)]
    rows += [row(None, f"w{i} " * (i % 30), rnd.choice(["hot", "b"])) for i in range(300)] + [row(150, "w " * n, "hot") for n in (5, 5, 6, 7)]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0d]+", text or ""))
    for d, text, _, source, *_ in rows:
        sizes[source] += size(text)
    target = plain_targets(sizes)
    taken, slack = Counter(), Counter()
    for r in got:
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
    full = mixing._mix(frame(spark, rows), None).collect()
    assert Counter((r.doc_id, r.size, r.copies) for r in full) == Counter((r.doc_id, r.size, r.copies) for r in got)
    assert Counter((r.doc_id, r.source, r.size) for r in full) == Counter((d, source, size(text)) for d, text, _, source, *_ in rows)
    for r in full:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source])
        taken[r.source] += r.taken
        slack[r.source] = max(slack[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(40, slack[s])
    again = mixing.mix(frame(spark, rows, parts=7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    # the documents come out as often as the mix says, rows of one doc_id and rows without one too
    mixed = mixing.mixed_documents(frame(spark, rows))
    assert mixed.columns == frame(spark).columns
    want = Counter()
    for r in full:
        want[r.doc_id, r.source, r.size] += r.copies
    assert Counter((r.doc_id, r.source, size(r.text)) for r in mixed.collect()) == +want


@pytest.mark.parametrize("kind", ["many", "equal", "one", "zero"])
def test_targets_of_many_sources(spark, monkeypatch, kind):
    """The level of all sources, whichever range holds it, against filling them step by step."""
    monkeypatch.setattr(mixing, "SOURCES", 50)
    rnd = random.Random(9)
    sizes = {"many": {f"s{i}": int(rnd.paretovariate(0.7) * 10) for i in range(300)} | {None: 7, "empty": 0}, "equal": {f"s{i}": 30 for i in range(40)}, "one": {"a": 5}, "zero": {"a": 0, None: 0}}[kind]
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    want = plain_targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    assert {r.source: r.source_size for r in got} == sizes
    assert [r.source for r in sorted(got, key=lambda r: r.rank)] == sorted(sizes, key=lambda s: (s is None, (s or "").encode())) and sorted(r.rank for r in got) == list(range(1, len(sizes) + 1))
    assert all(math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9) for r in got)


def test_mix_without_words(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(frame(spark, [row(1, None), row(2, "")])).collect()] == [0, 0]


def test_quality_comes_first(spark):
    rows = [row(i, "ten words " * 5, "a") for i in range(400)] + [row(1000 + i, "w " * 10, "b") for i in range(200)]
    weights = spark.createDataFrame([(i, 8.0 if i < 200 else 0.1) for i in range(400)], "doc_id long, weight double")
    got = mixing.mix(frame(spark, rows), weights).where("doc_id < 400 and taken > 0").collect()
    assert 0 < sum(r.doc_id >= 200 for r in got) < sum(r.doc_id < 200 for r in got) / 2


# --- toxicity


def toxic_rows(n=900):
    rnd = random.Random(4)
    word = lambda: rnd.choice("bcdfg") + rnd.choice("aeiou") + rnd.choice("lmnrst") + rnd.choice("aeiou")
    rows, labels = [], []
    for i in range(n):
        ws = [word() for _ in range(rnd.randrange(30, 120))]
        bad = i % 6 == 0
        if bad:
            for _ in range(4):
                ws.insert(rnd.randrange(len(ws)), rnd.choice(["awful", "vile!", "Nasty,", "horrid"]))
        rows.append(row(i, " ".join(ws)))
        if i % 5:
            labels.append((i, 1, int(bad)))
    labels += [(1, 1, 1), (1, 1, 0), (99999, 1, 1), (2, 1, None)]
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_rows()
    docs, marks = frame(spark, rows + ODD[:5]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    fold = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4")
    score = toxicity.scorer(docs, marks, learn_from=fold != 2)
    got = {r.doc_id: r.s for r in docs.select("doc_id", score("text").alias("s")).collect()}
    held = [d for d, *_ in rows if zlib.crc32(str(d).encode()) % 4 == 2 and d > 5]
    right = sum((got[d] >= toxicity.THRESHOLD) == (d % 6 == 0) for d in held)
    assert right >= 0.97 * len(held) and all(0 <= s <= 1 for s in got.values())
    first = Counter((r.doc_id, r.s) for r in docs.select("doc_id", score("text").alias("s")).collect())
    again = Counter((r.doc_id, r.s) for r in docs.repartition(5).select("doc_id", toxicity.scorer(docs.repartition(2), marks, learn_from=fold != 2)("text").alias("s")).collect())
    assert again == first


def plain_places(text):
    """Feature places of a text, from its words one by one."""
    h = lambda w, seed: xxhash.xxh3_64_intdigest(w, seed=seed)
    full = 2**64 - 1

    def spread(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = ((x ^ (x >> shift)) * factor) & full
        return x ^ (x >> 31)

    ws = ["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x20\x09-\x0d]+", text or "")]
    bare = [w.strip(toxicity.EDGE.decode()) or w for w in ws]
    own = [h(w.encode(), 0) for w in bare]
    found = own + [h(w[:n].encode(), n) for n in (4, 5) for w in bare]
    found += [spread((x * 3 + y) & full) for x, y in zip(own, own[1:], strict=False)] + [spread((x * 5 + y) & full) for x, y in zip(own, own[2:], strict=False)]
    return {x >> (64 - toxicity.BITS) for x in found}


def test_toxicity_equals_plain_ftrl(spark):
    """Per-coordinate FTRL-proximal, one feature at a time, in the order of the operator."""
    rows, labels = toxic_rows(300)
    rows += [row(400, "Ünï wörds, ÄÖ <b>html</b>! 'quoted' -- ... x"), row(401, None)]
    docs, marks = frame(spark, rows), spark.createDataFrame([x for x in labels if x[0] < 300 and x[2] is not None and x[0] > 2] + [(400, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.scorer(docs, marks)("text").alias("s")).collect()}
    known = sorted((r.doc_id, r.toxic) for r in marks.collect())
    text = {r[0]: r[1] for r in rows}
    z, n, free = defaultdict(float), defaultdict(float), 2**toxicity.BITS

    def weight(i):
        l1, l2 = (0.0, 0.0) if i == free else (toxicity.L1, toxicity.L2)
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + l2)

    def score(text):
        return 1 / (1 + math.exp(-sum(weight(i) for i in plain_places(text) | {free})))

    order = np.random.default_rng(0)
    for _ in range(toxicity.EPOCHS):
        for k in order.permutation(len(known)):
            doc, label = known[k]
            g = score(text[doc]) - label
            for i, w in [(i, weight(i)) for i in plain_places(text[doc]) | {free}]:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w
                n[i] += g * g
    assert all(math.isclose(got[d], score(t), rel_tol=1e-4, abs_tol=1e-6) for d, t in text.items())
    assert len({round(s, 3) for s in got.values()}) > 10


def test_toxicity_scores_follow_all_labels(spark, monkeypatch):
    # 200 toxic to 1,600 clean documents; the marked word stands in half of the toxic and in a twentieth of the clean ones
    bad = lambda i: i % 9 == 0
    marked = lambda i: i // 9 % (2 if bad(i) else 20) == 0
    docs = frame(spark, [row(i, "quite awful words" if marked(i) else "quite usual words") for i in range(1800)])
    # labels of no document teach nothing and count for nothing
    marks = spark.createDataFrame([(i, 1, int(bad(i))) for i in range(1800)] + [(10**6 + i, 1, 1) for i in range(500)], "doc_id long, quality int, toxic int")

    def scores():
        score = toxicity.scorer(docs, marks)
        return [r.s for r in spark.createDataFrame([("quite awful words",), ("quite usual words",)], "text string").coalesce(1).select(score("text").alias("s")).collect()]

    whole = scores()
    monkeypatch.setattr(toxicity, "CLEAN", 400)  # 1:2
    some = scores()
    assert all(abs(x - y) < 0.1 for x, y in zip(whole, some, strict=True)), (whole, some)
    assert abs(whole[1] - 100 / 1620) < 0.05 and abs(some[1] - 100 / 1620) < 0.05  # toxic ones of those without the word


def test_a_document_teaches_once(spark, monkeypatch):
    """A doc_id in 10,000 rows is one of the rows that are learned from."""
    monkeypatch.setattr(toxicity, "TOXIC", 20)
    monkeypatch.setattr(toxicity, "CLEAN", 20)
    seen = []
    keep = toxicity.save
    monkeypatch.setattr(toxicity, "save", lambda df, name: seen.append((name, keep(df, name))) or seen[-1][1])
    docs = frame(spark, [row(i, f"some {'bad' if i % 2 else 'good'} words {i}") for i in range(100)] + [row(1, "bad words again")] * 10_000)
    marks = spark.createDataFrame([(i, 1, i % 2) for i in range(100)], "doc_id long, quality int, toxic int")
    at, w = toxicity.fit(docs, marks, F.lit(True))
    learned = dict(seen)["toxicity"]
    assert learned.count() == learned.select("id").distinct().count() <= 40 and len(at) == len(w)


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.s < 1e-15 for r in frame(spark).select(toxicity.scorer(frame(spark), none)("text").alias("s")).collect())
    one = spark.createDataFrame([(6, 1, 1)], none.schema)
    assert all(r.s > 1 - 1e-15 for r in frame(spark).select(toxicity.scorer(frame(spark), one)("text").alias("s")).collect())
    assert toxicity.reject_toxic(frame(spark, []), none).count() == 0


# --- top k


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 100)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rnd = random.Random(6)
    rows = [(i, [rnd.gauss(0, 0.2) for _ in range(8)]) for i in range(600)]
    rows += [(600 + i, [0.5] * 8) for i in range(70)] + [(700, None), (720, [1.0, None] * 4), (740, [float("nan")] * 8), (760, [float("inf")] * 8), (780, []), (800, [0.0] * 8), (None, [1.0] * 8), (820, [0.1] * 3)]
    rows += [rows[0], rows[20]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string").repartition(4)
    got = Counter(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect())
    as_float = df.where("vec_id is not null and embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).collect()
    used = [(r.vec_id, [math.floor(64 * x) for x in r.e]) for r in as_float if all(x is not None and math.isfinite(x) for x in r.e)]
    want = Counter()
    for n, (q, v) in enumerate(used):
        if q % 20 == 0:  # repeated rows ask each, and are candidates each
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), c) for m, (c, w) in enumerate(used) if m != n)[:20]
            want.update((q, i + 1, c, -s) for i, (s, c) in enumerate(scores))
    assert got == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("kind", [np.float32, np.int64])
def test_threshold_stops_early(kind):
    """On vectors of few strong dimensions most are never scored; results are those of a full search."""
    rnd = np.random.default_rng(3)
    vectors = np.floor(64 * rnd.normal(size=(4000, 16)) * 0.5 ** np.arange(16)).astype(kind)
    lists = topk.SortedLists(np.arange(4000), np.arange(4000), vectors)
    queries = vectors[::80]
    scores = queries @ vectors.T
    scores[np.arange(50), np.arange(50) * 80] = np.iinfo(np.int32).min
    want = [sorted(zip(-line, range(4000), strict=True))[:20] for line in scores]
    for floors in (None, np.array([-w[19][0] for w in want]), np.array([-w[19][0] / 2 for w in want]).astype(kind)):
        lists.scored, got = 0, {i: list(zip(-s, r, strict=True)) for i, r, s in lists.top(np.arange(50) * 80, queries, 20, floors)}
        assert all([x for x in got.get(i, []) if floors is None or -x[0] >= floors[i]] == [x for x in w if floors is None or -x[0] >= floors[i]] for i, w in enumerate(want))
        assert lists.scored < 0.5 * 50 * 4000
    # a floor that no vector reaches: nothing is scored
    lists.scored = 0
    assert list(lists.top(np.arange(50), queries, 20, lists.bounds(queries)[:, 0] + 1)) == [] and lists.scored == 0


def test_threshold_search_of_even_dimensions_is_walked():
    """On vectors without strong dimensions the bound stops late, but it stops; no vector is scored twice."""
    rnd = np.random.default_rng(4)
    vectors = np.floor(64 * rnd.normal(size=(2000, 64)) / 8).astype(np.float32)
    lists = topk.SortedLists(np.arange(2000), np.arange(2000), vectors)
    got = {i: p.tolist() for i, p, _ in lists.top(np.arange(30), vectors[:30], 20)}
    for i in range(30):
        scores = vectors @ vectors[i]
        scores[i] = -(2**20)
        assert got[i] == np.lexsort((np.arange(2000), -scores))[:20].tolist()
    assert max(lists.stopped) < 2000 and lists.scored <= 30 * 1999


def test_blocks_are_shared_by_small_groups(monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 100)
    assert topk.starts([30, 30, 50, 350, 20, 70, 20]) == ([0, 0, 1, 2, 5, 5, 6], [1, 1, 1, 3, 1, 1, 1], 7)
    assert topk.starts([]) == ([], [], 0)


# --- the pipeline


def test_pipeline(spark, tmp_path):
    rows, labels = toxic_rows(400)
    passage = " ".join(hashlib.md5(str(i).encode()).hexdigest()[:6] for i in range(60))
    clean = [r for r in rows if r[0] % 6]
    rows += [row(2000 + i, clean[i][1] + "\n" + passage) for i in range(3)]  # the passage recurs
    rows += [row(3000 + i, clean[10 + i][1]) for i in range(3)] + [row(3100 + i, clean[20 + i][1] + " added words") for i in range(3)]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    spark.createDataFrame(rows, SCHEMA).select(*columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    toxic = {r[0] for r in rows if r[0] < 2000 and r[0] % 6 == 0}
    left = {r.doc_id for r in kept["toxicity"]}
    assert len(toxic & left) <= 0.05 * len(toxic) and len(left) >= len(rows) - len(toxic) - 5
    assert sum(passage in r.text for r in kept["line_dedup"]) == 1 and len(kept["line_dedup"]) == len(kept["toxicity"])
    stayed = {r.doc_id for r in kept["near_dedup"]}
    assert not stayed & {3100, 3101, 3102} and {r[0] for r in clean[30:]} & left <= stayed
    assert {r.doc_id for r in kept["mixing"]} <= stayed
    assert {r.doc_id for r in kept["packing"]} == {r.doc_id for r in kept["mixing"]}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["packing"])


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES], ids=lambda s: s[0])
def test_stages_take_odd_and_empty_documents(spark, tmp_path, stage):
    spark.createDataFrame([(6, 1, 0), (9, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = stage[1](spark, frame(spark), str(tmp_path))
    assert got.count() > 0
    assert stage[1](spark, frame(spark, []), str(tmp_path)).count() == 0
