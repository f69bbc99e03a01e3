"""Requests taken one after the other, against a plain loop."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quoteloom.adapters import as_of
from quoteloom.operators import accounts, chains, prices
from quoteloom.schemas import PRICES, USERS

NOW = dt.datetime(2026, 1, 2)


def one_by_one(claims, owners):
    """{seq: accepted}, and who has what in the end."""
    has, holder, out = dict(owners), {k: r for r, k in owners}, {}
    for seq, row, key in sorted(claims):
        out[seq] = holder.get(key, row) == row
        if out[seq]:
            if holder.get(has.get(row)) == row:
                del holder[has[row]]
            has[row], holder[key] = key, row
    return out, has


def settled(spark, claims, owners):
    df = chains.settle(spark.createDataFrame(claims, "seq long, row string, key string"), spark.createDataFrame(owners, "row string, key string"))
    return {r.seq: r.accepted for r in df.collect()}


CASES = {
    # each row moves to the key of the next; the last one goes first, or last
    "chain": ([(i, f"r{i}", f"k{i - 1}") for i in range(1, 12)] + [(0, "r0", "away")], [(f"r{i}", f"k{i}") for i in range(12)]),
    "chain that waits": ([(i, f"r{i}", f"k{i + 1}") for i in range(11)] + [(20, "r11", "away"), *((40 - i, f"r{i}", f"k{i + 1}") for i in range(11))], [(f"r{i}", f"k{i}") for i in range(12)]),
    "swap by a third key": ([(1, "a", "kb"), (2, "a", "other"), (3, "b", "ka"), (4, "a", "kb")], [("a", "ka"), ("b", "kb")]),
    "own key again": ([(1, "a", "ka"), (2, "b", "ka"), (3, "a", "x"), (4, "b", "ka"), (5, "b", "ka"), (6, "a", "ka")], [("a", "ka"), ("b", "kb")]),
    "new rows": ([(1, "n", "k"), (2, "m", "k"), (3, "n", "l"), (4, "m", "k")], [("z", "zz")]),
}


@pytest.mark.parametrize("case", CASES)
def test_settled_as_one_by_one(spark, case):
    claims, owners = CASES[case]
    got = settled(spark, claims, owners)
    assert got == one_by_one(claims, owners)[0]
    if case.startswith("chain"):
        assert all(got[s] for s, _, _ in claims if s >= 20 or case == "chain")


@pytest.mark.parametrize("cuts", [[], [20, 45, 90]])
def test_hot_rows_and_keys(spark, monkeypatch, cuts):
    """A third of the claims are of one row, a third of one key; with cuts these are spread over spans."""
    monkeypatch.setattr(chains, "spans", lambda df, at: cuts)
    r = random.Random(11)
    owners = [(f"r{i}", f"k{i}") for i in range(30)]
    claims = [(s, "r0" if r.random() < 0.33 else f"r{r.randrange(30)}", "k5" if r.random() < 0.33 else f"k{r.randrange(45)}") for s in range(120)]
    assert settled(spark, claims, owners) == one_by_one(claims, owners)[0]


def test_spans_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(chains, "ROWS", 100)
    cuts = chains.spans(spark.range(1000).withColumn("seq", F.col("id") * F.col("id")), "seq")
    assert len(cuts) == 9 and cuts == sorted(cuts) and 300**2 <= cuts[3] <= 500**2


@pytest.mark.parametrize("cuts", [[], [3, 7]])
def test_nearest(spark, cuts):
    rows = [("a", i, i if i in (2, 6) else None) for i in (1, 2, 3, 5, 6, 9)] + [("b", 4, 40)]
    df = spark.createDataFrame(rows, "g string, at long, v long")
    got = {(r.g, r["at"]): (r.before, r.later) for r in chains.nearest(chains.nearest(df, "g", "at", F.col("v"), "before", cuts), "g", "at", F.col("v"), "later", cuts, after=True).collect()}
    assert got == {("a", 1): (None, 2), ("a", 2): (None, 6), ("a", 3): (2, 6), ("a", 5): (2, 6), ("a", 6): (2, None), ("a", 9): (6, None), ("b", 4): (None, None)}


def test_chain_of_pointers(spark):
    pointers = spark.createDataFrame([("a", i, i + 3) for i in range(100)] + [("b", 1, None)], "g string, at long, next long")
    starts = spark.createDataFrame([("a", 1), ("b", 1)], "g string, at long")
    assert {tuple(r) for r in chains.on_chain(starts, pointers, "g", "at").collect()} == {("a", i) for i in range(1, 103, 3)} | {("b", 1)}


def price(i, symbol):
    return (i, symbol, "Company", NOW, 1.0, 1.0, 1.0, 1.0, None, 1.0, "s", "", "u", NOW, NOW)


def edit(seq, i, symbol, close="2"):
    return (seq, i, symbol, "Company", "2026-01-02", "1", "1", "1", close, "", "1", "")


EDIT = "edit_seq long, _id string, symbol string, companyName string, tradeDate string, open string, high string, low string, close string, adjustedClose string, volume string, notes string"


def test_price_edits_swap_keys(spark):
    table = spark.createDataFrame([price("1", "AA"), price("2", "BB"), price("3", "CC")], PRICES)
    edits = spark.createDataFrame([edit(1, "1", "bb"), edit(2, "1", "tmp"), edit(3, "2", " aa "), edit(4, "1", "BB", "9"), edit(5, "9", "ZZ"), edit(6, "3", "x"), edit(7, "3", "AA"), edit(8, "1", "BB", "10")], EDIT)
    done, rejects = prices.replay_price_edits(table, edits, as_of())
    assert {(r._id, r.symbol, r.close) for r in done.collect()} == {("1", "BB", 10.0), ("2", "AA", 2.0), ("3", "CC", 1.0)}
    assert sorted((r.edit_seq, r.status, r.message) for r in rejects.collect()) == [(1, 409, prices.TAKEN), (5, 404, prices.NOT_FOUND), (6, 400, prices.INVALID_INPUT), (7, 409, prices.TAKEN)]
    # judged against the table before the batch, the swap is refused
    assert prices.apply_price_edits(table, edits, as_of())[1].where("edit_seq in (3, 4)").count() == 2


def test_user_edits_take_freed_mail(spark):
    users = spark.createDataFrame([(i, "Name", f"{i}@mail.test", "user", None, NOW, NOW) for i in "abc"], USERS)
    edits = spark.createDataFrame([(1, "b", "New", "a@mail.test", "user"), (2, "a", "New", "z@mail.test", "user"), (3, "b", "Newer", "A@mail.test ", "admin"), (4, "c", "New", "a@mail.test", "user"), (5, "c", "N", "q@mail.test", "user")], "seq long, _id string, name string, email string, role string")
    done, rejects = accounts.replay_user_edits(users, edits, as_of())
    assert {(r._id, r.name, r.email, r.role) for r in done.collect()} == {("a", "New", "z@mail.test", "user"), ("b", "Newer", "a@mail.test", "admin"), ("c", "Name", "c@mail.test", "user")}
    assert sorted((r.seq, r.status) for r in rejects.collect()) == [(1, 409), (4, 409), (5, 400)]


def test_no_requests(spark):
    users = spark.createDataFrame([("a", "Name", "a@mail.test", "user", None, NOW, NOW)], USERS)
    done, rejects = accounts.replay_user_edits(users, spark.createDataFrame([], "seq long, _id string, name string, email string, role string"), as_of())
    assert done.count() == 1 and rejects.isEmpty()
