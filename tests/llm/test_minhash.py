import random
import re

import duckdb
import pytest

from quoteloom.llm import minhash
from quoteloom.llm.minhash import drop_near_duplicates, near_duplicates

SCHEMA = "doc_id long, text string, rep string"


def brute(rows, width, percent):
    """Union-find over all pairs of documents."""
    sets = {}
    for doc, text, *_ in rows:
        w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in re.findall(r"[^\x20\x09-\x0d]+", text or "")]
        k = min(width, len(w))
        sets[doc] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def corpus():
    rnd = random.Random(7)
    text = lambda n: [rnd.choice("abcdefghij") + str(rnd.randrange(400)) for _ in range(n)]
    rows, doc = [], 100
    for size in (120, 200, 60):
        base = text(size)
        for _ in range(40):  # copies at many distances from their base, and from each other
            copy = list(base)
            for _ in range(rnd.randrange(0, 9)):
                copy[rnd.randrange(size)] = "edit" + str(rnd.randrange(10**6))
            rows.append((doc, " ".join(copy), "x"))
            doc += 1
    chain = text(200)
    for i in range(20):  # only neighbours are near
        chain[i * 4] = f"link{i}"
        rows.append((doc, " ".join(chain), "x"))
        doc += 1
    rows += [(doc + i, t, "x") for i, t in enumerate([None, "", " \n\t", "one", "One", "one two", "É x y", "é x y", "a b c d", "word " * 30000])]
    rows += [(5, rows[0][1], "x"), (6, rows[0][1].upper().replace(" ", "\n"), "x"), (6, rows[0][1].upper().replace(" ", "\n"), "x")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "percent", "members"), [(3, 85, 1024), (5, 80, 5), (3, 85, 2)])
def test_components_equal_brute_force(spark, monkeypatch, width, percent, members):
    """With small blocks most buckets are dealt out, or their members meet by prefixes."""
    monkeypatch.setattr(minhash, "MEMBERS", members)
    rows = corpus()
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), width, percent).collect()
    assert len(got) == len({r[0] for r in rows})
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows, width, percent)


def test_empty_and_drop(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(none).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, None, None), (None, "a b c d e f", "z")], SCHEMA)
    assert sorted(map(str, (r.doc_id for r in drop_near_duplicates(docs).collect()))) == ["1", "3", "None"]


def test_prefixes_meet_wherever_sets_may_be_linked():
    """Of any two sets at the threshold, whatever the order of shingles."""
    r = random.Random(2)
    for percent in (80, 85):
        for _ in range(3000):
            n = r.randrange(1, 60)
            common = r.randrange(n + 1)
            x, y = set(range(n)), set(range(common)) | set(range(100, 100 + r.randrange(0, 20)))
            if not y or 100 * len(x & y) < percent * len(x | y):
                continue
            order = r.sample(range(200), 200)
            x, y = sorted((sorted(x, key=order.__getitem__), sorted(y, key=order.__getitem__)), key=len)
            assert set(x[: minhash.prefix_lengths(len(x), percent)[0]]) & set(y[: minhash.prefix_lengths(len(y), percent)[1]])


def family(n, tail=24, seed=1):
    """Documents that share 98 of 120 shingles or so, and nothing else."""
    r = random.Random(seed)
    head = [f"w{i}" for i in range(100)]
    return [(i, " ".join(head + [f"t{r.randrange(10**9)}" for _ in range(tail)]), "x") for i in range(n)]


@pytest.mark.parametrize("near", [0, 40])
def test_rows_of_families_do_not_grow(spark, monkeypatch, near):
    """Families just below the threshold: no more rows of blocks a member for twice the members; near copies inside are found."""
    monkeypatch.setattr(minhash, "MEMBERS", 64)
    seen, keep = {}, minhash.save
    monkeypatch.setattr(minhash, "save", lambda df, name: seen.setdefault(name, keep(df, name)) if name == "blocks" else keep(df, name))
    rows = {}
    for n in (1000, 2000):
        seen.clear()
        docs = family(n)
        docs += [(n + i, docs[i * 20][1].replace("w50 ", f"new{i} "), "x") for i in range(near)]
        got = near_duplicates(spark.createDataFrame(docs, SCHEMA).repartition(5), 3, 85).where("not kept").collect()
        assert {(r.doc_id, r.component_id) for r in got} == {(n + i, i * 20) for i in range(near)}
        rows[n] = seen["blocks"].count() / n
    assert rows[2000] <= 1.1 * rows[1000] + 0.1 and rows[2000] < 5


def test_blocks_of_a_component_and_a_few_others(spark):
    """A bucket of one component of 10,000 with ten others, and one of 900 components: rows in proportion, and all meet."""
    sizes = spark.range(50_000).selectExpr("id as rep", "100L as n")
    of = spark.range(50_000).selectExpr("id as rep", "case when id between 20000 and 29999 then 20000L else id end as comp")
    none = spark.createDataFrame([], "rep long, text string")
    bucket = lambda number, lo, hi: spark.range(lo, hi).selectExpr(f"{number}L as bucket", "id as rep", f"{hi - lo}L as size")
    rows = lambda shared: minhash.residual(shared, sizes, of, none, 3, 85)
    assert rows(bucket(8, 0, 900)).count() == 900
    assert rows(bucket(9, 19_990, 30_000)).count() == 10_000 + 10 * 10
    blocks = {}
    for r in rows(bucket(9, 19_990, 24_000)).collect():
        blocks.setdefault(r.gid, set()).add(r.rep)
    met = {(a, b) for m in blocks.values() for a in m for b in m if a < 20_000 and a < b}
    assert met == {(a, b) for a in range(19_990, 20_000) for b in range(a + 1, 24_000)}


def test_sql_equals_brute_force():
    rows = [(d, t) for d, t, _ in {r[0]: r for r in corpus() if len(r[1] or "") < 10_000}.values()]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    got = {d: (n, c, k) for c, d, k, n in con.sql(f"select component_id, doc_id, kept, n_shingles from ({minhash.ORACLE})").fetchall()}
    assert got == brute(rows, 3, 85)
