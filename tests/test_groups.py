"""Claims by groups of rows and keys that have nothing in common."""

import random

import pytest

from quoteloom.adapters import as_of
from quoteloom.operators import accounts, chains, prices
from quoteloom.schemas import PRICES, USERS

from .test_ordered import CASES, EDIT, NOW, edit, one_by_one, price, settled


def test_rounds_do_not_grow_with_waiting(spark, monkeypatch):
    """Many short rings, in each of which a key waits for several others: few tables are written, however long they wait."""
    names, save = [], chains.save
    monkeypatch.setattr(chains, "save", lambda df, name: names.append(name) or save(df, name))
    r = random.Random(3)
    owners = [(f"r{g}.{i}", f"k{g}.{i}") for g in range(40) for i in range(8)]
    claims = [(s, f"r{s % 40}.{r.randrange(8)}", f"k{s % 40}.{r.randrange(9)}") for s in range(1600)]
    assert settled(spark, claims, owners) == one_by_one(claims, owners)[0]
    assert len(names) < 20 and "until" not in names


@pytest.mark.parametrize("most", [0, 12, 24])
def test_large_groups_by_joins(spark, monkeypatch, most):
    """Groups above the bound are settled by joins, the others one by one, in one call."""
    monkeypatch.setattr(chains, "GROUP", most)
    cases = list(CASES.values())
    claims = sorted((s * 10 + n, f"{n}{row}", f"{n}{key}") for n, (given, _) in enumerate(cases) for s, row, key in given)
    owners = [(f"{n}{row}", f"{n}{key}") for n, (_, has) in enumerate(cases) for row, key in has]
    assert settled(spark, claims, owners) == one_by_one(claims, owners)[0]


@pytest.mark.parametrize("cuts", [[], [20, 45, 90]])
def test_hot_rows_and_keys_by_joins(spark, monkeypatch, cuts):
    monkeypatch.setattr(chains, "GROUP", 0)
    monkeypatch.setattr(chains, "spans", lambda df, at: cuts)
    r = random.Random(11)
    owners = [(f"r{i}", f"k{i}") for i in range(30)]
    claims = [(s, "r0" if r.random() < 0.33 else f"r{r.randrange(30)}", "k5" if r.random() < 0.33 else f"k{r.randrange(45)}") for s in range(120)]
    assert settled(spark, claims, owners) == one_by_one(claims, owners)[0]


def test_groups_of_long_chains(spark):
    """Two chains of 300 rows and a row alone: three groups."""
    links = [(f"{c}{i}", i * 2 + o + d) for c, o in (("a", 0), ("b", 1000)) for i in range(300) for d in (0, 2)] + [("c", -5)]
    found = {r.row: r.group for r in chains.linked(spark.createDataFrame(links, "row string, no long")).collect()}
    assert len(found) == 601 and len(set(found.values())) == 3
    assert all(len({g for row, g in found.items() if row[0] == c}) == 1 for c in "abc")


def test_replays_settle_in_one_pass(spark, monkeypatch):
    """Statuses of a batch of price edits and one of user edits, on few keys, against a plain loop; no round of joins is needed."""
    names, save = [], chains.save
    monkeypatch.setattr(chains, "save", lambda df, name: names.append(name) or save(df, name))
    r, rows = random.Random(5), [f"{i:02d}" for i in range(30)]
    asked = [(s, r.choice([*rows, "none"]), f"K{r.randrange(60) // 2 * 2:02d}") for s in range(200)]
    want = one_by_one([x for x in asked if x[1] != "none"], [(i, f"K{i}") for i in rows])[0]
    want = sorted((s, 404 if row == "none" else 409) for s, row, _ in asked if not want.get(s, False))
    table = spark.createDataFrame([price(i, f"K{i}") for i in rows], PRICES)
    rejects = prices.replay_price_edits(table, spark.createDataFrame([edit(s, row, key) for s, row, key in asked], EDIT), as_of())[1]
    assert sorted((x.edit_seq, x.status) for x in rejects.collect()) == want
    users = spark.createDataFrame([(i, "Name", f"k{i}@mail.test", "user", None, NOW, NOW) for i in rows], USERS)
    edits = spark.createDataFrame([(s, row, "New", f"{key}@mail.test", "user") for s, row, key in asked], "seq long, _id string, name string, email string, role string")
    rejects = accounts.replay_user_edits(users, edits, as_of())[1]
    assert sorted((x.seq, x.status) for x in rejects.collect()) == want
    assert "until" not in names
