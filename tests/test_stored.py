"""What is stored beside a table so that less of it is read: universe, sketches, trigrams, ranges."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quoteloom.operators import browse, layout, search, universe
from quoteloom.operators.prices import NEWEST, admin_overview, approximate_overview, company_sketches, filter_symbol, stock_universe
from quoteloom.schemas import PRICES, USERS

START = dt.datetime(2024, 1, 1)


def price(i, symbol, day, close=1.0, notes=""):
    at = START + dt.timedelta(days=day)
    return (f"{i:06d}", symbol, f"{symbol} Company", at, 1.0, 1.0, 1.0, close, None, 5.0, "s", notes, "u", START, START)


def frame(spark, rows):
    return spark.createDataFrame(rows, PRICES)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_universe_after_each_of_ten_batches(spark):
    """Inserts of old and new days, edits that move rows, deletes of the newest rows of all symbols and of whole symbols."""
    r = random.Random(4)
    rows = {i: price(i, f"S{r.randrange(12)}", r.randrange(400)) for i in range(250)}
    state, n = universe.universe_state(frame(spark, list(rows.values()))), 250
    assert plain(universe.universe_of(state)) == plain(stock_universe(frame(spark, list(rows.values()))))
    refilled = 0
    for batch in range(10):  # ten batches
        changes = []
        newest = sorted(rows, key=lambda i: rows[i][3], reverse=True)
        for i in {0: newest[:40], 3: [i for i in rows if rows[i][1] in ("S1", "S2")], 7: newest[:60]}.get(batch, r.sample(sorted(rows), 8)):
            changes.append((*rows.pop(i), "delete"))
        for i in r.sample(sorted(rows), 10):
            changes.append((*rows[i], "delete"))
            rows[i] = price(i, rows[i][1] if r.random() < 0.7 else f"S{r.randrange(14)}", r.randrange(500), r.random())
            changes.append((*rows[i], "insert"))
        for _ in range(r.randrange(15)):
            rows[n] = price(n, f"S{r.randrange(14)}", r.randrange(500))
            changes.append((*rows[n], "insert"))
            n += 1
        r.shuffle(changes)
        table = frame(spark, list(rows.values()))
        df = spark.createDataFrame(changes, StructType([*PRICES.fields, StructField("kind", StringType())]))
        # a table without rows for symbols that need none of it gives the same
        state = spark.createDataFrame(universe.update_universe(state, df, table).collect(), state.schema)
        assert plain(universe.universe_of(state)) == plain(stock_universe(table))
        refilled += state.where(F.size("newest") == universe.KEEP).count()
    assert refilled


def test_old_rows_are_counted_without_the_table(spark):
    table = frame(spark, [price(i, "A", i) for i in range(20)])
    state = universe.universe_state(table)
    changes = frame(spark, [price(30, "A", 3), price(31, "B", 1)]).withColumn("kind", F.lit("insert"))
    after = universe.update_universe(state, changes, table.limit(0))
    assert {(r.symbol, r.recordCount, len(r.newest)) for r in after.collect()} == {("A", 21, 4), ("B", 1, 1)}


def test_rows_that_change_several_times(spark):
    """Edited twice, edited there and back, inserted and deleted, deleted and inserted elsewhere: only what is left counts."""
    rows = [price(i, "A", i) for i in range(9)] + [price(20, "B", 5)]
    state = universe.universe_state(frame(spark, rows))
    moved, again = price(8, "A", 30, 7.0), price(8, "C", 31, 8.0)
    short, other = price(40, "A", 99), price(7, "A", 50)
    changes = [(rows[8], "delete"), (moved, "insert"), (moved, "delete"), (again, "insert"), (short, "insert"), (short, "delete"), (rows[7], "delete"), (other, "insert"), (other, "delete"), (rows[7], "insert"), (rows[9], "delete")]
    table = frame(spark, [*rows[:8], again])
    for order in (changes, changes[::-1]):
        df = spark.createDataFrame([(*row, kind) for row, kind in order], StructType([*PRICES.fields, StructField("kind", StringType())]))
        assert plain(universe.universe_of(universe.update_universe(state, df, table))) == plain(stock_universe(table))


@pytest.mark.parametrize("companies", [3, 20_000])
def test_sketches_of_years(spark, companies):
    rows = spark.range(60_000).select(
        F.col("id").cast("string").alias("_id"), F.concat(F.lit("C"), (F.xxhash64("id") % companies).cast("string")).alias("symbol"), F.expr("make_timestamp_ntz(2000 + int(id % 7), 1, 1, 0, 0, 0)").alias("tradeDate")
    )
    users = spark.createDataFrame([("1", "n", "e", "user", None, START, START), ("2", "n", "e", "admin", None, START, START)], USERS)
    sketches = spark.createDataFrame(company_sketches(rows).collect(), "trade_year int, rows long, companies binary")
    assert sketches.count() == 7
    got, want = approximate_overview(users, sketches).first(), admin_overview(users, rows).first()
    assert (got.userCount, got.adminCount, got.stockRecordCount) == (want.userCount, want.adminCount, want.stockRecordCount)
    assert abs(got.companyCount - want.companyCount) <= 0.025 * want.companyCount
    assert tuple(approximate_overview(users, sketches.limit(0)).first()) == (1, 1, 0, 0)


def test_search_by_trigrams_equals_reading_all(spark, tmp_path):
    r = random.Random(2)
    words = ["Nord", "Süd", "100%", "a_b", "Öl & Gas", "ABC", "bca", "  ", "[x]", "İs"]
    rows = [price(i, r.choice(["AB", "ABCD", "ZZTOP"]), i, notes=" ".join(r.choice(words) for _ in range(r.randrange(4)))) for i in range(400)]
    df = frame(spark, rows).withColumn("key", F.lit("x")).persist()
    names = ("companyName", "symbol", "notes")
    search.write_index(df, f"{tmp_path}/index", "_id", *names)
    texts = sorted({t[i : i + k].strip().lower() for row in rows[:40] for t in (row[1], row[2], row[11]) for k in (3, 5) for i in range(len(t))})
    for query in [*r.sample(texts, 12), "zzz", "ab", "", None, "top com", "abcdc", " nord ", "100%", "a_b", "süd"]:
        got = search.search_indexed(df, f"{tmp_path}/index", "_id", query, *names)
        assert {x._id for x in got.select("_id").collect()} == {x._id for x in browse.containing(df, query, *names).select("_id").collect()}, query
    # of the postings, one folder for each trigram that is looked up, and rows of these trigrams alone
    found = search.candidates(spark, f"{tmp_path}/index", "zztop company")
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [folder" in plan and "PushedFilters: [In(gram" in plan
    assert found.count() == sum(x[1] == "ZZTOP" for x in rows)
    df.unpersist()


def test_a_symbol_is_in_few_files(spark, tmp_path):
    rows = [price(i, f"S{i % 100:02d}", i % 700) for i in range(6000)] + [price(9000 + i, "HOT", i % 700) for i in range(3000)]
    layout.write_prices(frame(spark, rows).repartition(8), f"{tmp_path}/table", parts=24)
    table = spark.read.parquet(f"{tmp_path}/table").drop("trade_year").select(*PRICES.names)
    everything = len(table.inputFiles())
    for symbol in ("s07", "HOT", "NONE", "S99"):
        got = layout.read_symbol(spark, f"{tmp_path}/table", symbol)
        assert plain(got) == plain(filter_symbol(table, symbol))
        opened = len(got.inputFiles())
        assert opened <= {"HOT": everything / 2, "NONE": 2}.get(symbol, 4) and everything >= 20
    (year,) = {x.tradeDate.year for x in layout.read_symbol(spark, f"{tmp_path}/table", "S07", years=[2025]).collect()}
    assert year == 2025
    layout.write_prices(frame(spark, []), f"{tmp_path}/none")
    assert layout.read_symbol(spark, f"{tmp_path}/none", "S07").isEmpty()


def test_stored_pages(spark, tmp_path):
    df, order = spark.range(60_000).withColumn("k", F.xxhash64("id") % 1000), [F.desc("k"), F.col("id")]
    layout.store_order(df, order, f"{tmp_path}/order", parts=40)
    want = [tuple(r) for r in df.orderBy(*order).collect()]
    for page in (1, 2, 250, 251, 10_000, 10**9, -5):
        got, info = layout.stored_page(spark, f"{tmp_path}/order", order, page, 6)
        at = min(max(page, 1), 10_000)
        assert [tuple(r) for r in got.collect()] == want[(at - 1) * 6 : at * 6] and info == {"page": at, "totalPages": 10_000, "total": 60_000, "shown": 6}
        assert 1 <= len(_ranges(got)) <= 2
    whole, info = layout.stored_page(spark, f"{tmp_path}/order", order, 1, 100_000)
    assert whole.count() == 60_000 == info["shown"]
    layout.store_order(df.limit(0), order, f"{tmp_path}/none")
    none, info = layout.stored_page(spark, f"{tmp_path}/none", order, 3, 6)
    assert none.isEmpty() and info["total"] == 0 and info["page"] == 1


def _ranges(df):
    """The ranges that the plan's partition filter names."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    part = plan.split("PartitionFilters: [")[1].split("]")[0]
    return [int(x) for x in part.split("IN (")[1].split(")")[0].split(",")] if "IN (" in part else [int(part.split("=")[1].split(")")[0].split(",")[0])]


def test_numbering_keeps_nothing_in_memory(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    rows = browse.numbered(frame(spark, [price(i, "A", i % 5) for i in range(50)]), [F.desc(c) for c in NEWEST])
    assert rows.agg(F.max("n")).first()[0] == 50 and spark.sparkContext._jsc.getPersistentRDDs().size() == before
