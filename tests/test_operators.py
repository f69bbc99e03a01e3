"""Rules that the SQL of the catalog does not reach, on tiny tables, and plans."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quoteloom import catalog
from quoteloom.functions import scalars, validation
from quoteloom.operators import accounts, browse, prices, reports
from quoteloom.plans import preview
from quoteloom.schemas import PRICES, REPORTS

T0 = dt.datetime(2024, 1, 1)
TINY = "/root/testdata/sf0.001"


def price_rows(spark, *rows):
    """rows: (_id, symbol, day, createdAt hour, close)."""
    full = [(i, s, f"Company {s}", T0 + dt.timedelta(days=d), 1.0, 1.0, 1.0, c, None, 5.0, "x", "50%_off", "u", T0 + dt.timedelta(hours=h), T0) for i, s, d, h, c in rows]
    return spark.createDataFrame(full, PRICES)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("cell", "value", "bad"),
    [("1,182.5", 1182.5, False), (",", None, False), ("", None, False), (None, None, False), ("  ", None, False), (", ,", 0.0, False), ("1d", None, True), ("NaN", None, True), ("0x1F", 31.0, False), ("1e3", 1000.0, False), ("-5", -5.0, False), (".5", 0.5, False), ("5.", 5.0, False), ("Infinity", float("inf"), False), ("inf", None, True), ("0b101", 5.0, False), ("1 2", None, True)],
)
def test_parse_number(spark, cell, value, bad):
    got = one(spark, scalars.parse_number(F.lit(cell).cast("string")))
    assert (got.value, got.bad) == (value, bad)


@pytest.mark.parametrize(
    ("cell", "value"),
    [("2026-01-02", T0.replace(2026, 1, 2)), ("2026", T0.replace(2026)), ("2026-01-02T09:30:00+02:00", dt.datetime(2026, 1, 2, 7, 30)), ("1/2/2026", T0.replace(2026, 1, 2)), ("Jan 2, 2026", T0.replace(2026, 1, 2)), ("2026/1/2", T0.replace(2026, 1, 2)), ("2026-02-30", None), ("soon", None), ("12:30", None), (None, None)],
)
def test_parse_trade_date(spark, cell, value):
    assert one(spark, scalars.utc_wall_time(scalars.parse_trade_date(F.lit(cell).cast("string")))) == value


def test_stored_filename(spark):
    names = ["A.PDF", "a b.pdf", "x/y.tar.gz", "none", ".pdf"]
    got = [one(spark, scalars.stored_filename(F.lit(n), F.lit(1))) for n in names]
    assert got == ["1-A-PDF.pdf", "1-a-b.pdf", "1-y-tar.gz", "1-none.pdf", "1--pdf.pdf"]


def test_newest_value_may_be_null(spark):
    rows = price_rows(spark, ("1", "A", 0, 0, 1.0), ("2", "A", 1, 0, None), ("3", "A", 1, 0, 3.0), ("4", "A", 1, 0, None))
    got = prices.stock_universe(rows).first()
    assert (got.latestClose, got.recordCount) == (None, 4)  # the largest _id among equals


def test_filter_symbol_is_not_trimmed(spark):
    rows = price_rows(spark, ("1", "A", 0, 0, 1.0))
    assert prices.filter_symbol(rows, "a").count() == 1
    assert prices.filter_symbol(rows, " a").count() == 0
    assert prices.filter_symbol(rows, "").count() == 1


def test_search_is_literal(spark):
    rows = price_rows(spark, ("1", "A", 0, 0, 1.0))
    assert browse.search_prices(rows, "50%_O").count() == 1
    assert browse.search_prices(rows, "5_%").count() == 0


def test_pages_are_clamped_and_cover_the_table(spark):
    df = spark.range(13)
    pages = [browse.paginate(df, [F.col("id")], p, 5) for p in (1, 2, 3)]
    assert [r.id for rows, _ in pages for r in rows.collect()] == list(range(13))
    assert browse.page_info(13, 9, 5) == {"page": 3, "totalPages": 3, "total": 13, "shown": 3}
    assert browse.page_info(0, -1, 5) == {"page": 1, "totalPages": 1, "total": 0, "shown": 0}


def test_deep_pages_are_taken_by_number(spark, monkeypatch):
    monkeypatch.setattr(browse, "NEAR", 10)
    df = spark.range(50).selectExpr("id", "'x' as part", "'y' as __start", "'z' as number", "'v' as row")
    pages = [browse.paginate(df, [F.desc("id")], p, 7)[0] for p in range(1, 9)]
    assert [r.id for rows in pages for r in rows.collect()] == list(range(49, -1, -1)) and all(p.columns == df.columns for p in pages)


def test_edit_of_a_taken_day_is_refused(spark):
    rows = price_rows(spark, ("1", "A", 0, 0, 1.0), ("2", "A", 1, 0, 1.0))
    cells = dict(companyName="Comp", open="1", high="1", low="1", close="1", adjustedClose="", volume="1,0", notes=None)
    edits = [(1, "1", "ab", "2024-01-05", {**cells, "volume": "1"}), (2, "2", "A ", "2024-01-01", {**cells, "volume": "1"}), (3, "1", "ab", "2024-01-06", cells), (4, "9", "ab", "2024-01-06", {**cells, "volume": "1"})]
    df = spark.createDataFrame([dict(edit_seq=s, _id=i, symbol=y, tradeDate=d, **c) for s, i, y, d, c in edits], "edit_seq long, _id string, symbol string, tradeDate string, companyName string, open string, high string, low string, close string, adjustedClose string, volume string, notes string")
    table, rejects = prices.apply_price_edits(rows, df, F.lit(T0))
    assert {(r.edit_seq, r.status) for r in rejects.collect()} == {(2, 400), (3, 400), (4, 404)}
    assert {r.symbol for r in table.collect()} == {"AB", "A"}


def test_seeding_twice_is_silent_and_self_means_user(spark):
    users = spark.createDataFrame([], "_id string, name string, email string, role string, lastLoginAt timestamp_ntz, createdAt timestamp_ntz, updatedAt timestamp_ntz")
    asked = spark.createDataFrame([(1, "Ann A", "A@x.test ", "admin", "self"), (2, "Bob", "a@x.test", "user", "seed"), (3, "Cy", "c@x.test", None, "seed"), (4, "D", "d@x.test", "user", "admin")], "seq long, name string, email string, role string, kind string")
    table, rejects = accounts.register_users(users, asked, F.lit(T0))
    assert {(r.email, r.role) for r in table.collect()} == {("a@x.test", "user"), ("c@x.test", "admin")}
    assert [(r.seq, r.status) for r in rejects.collect()] == [(4, 400)]


def test_report_beyond_the_newest_eight_is_not_seen(spark):
    rows = [(str(i), "A", "C", f"{i}.pdf", None, None, 1, None, "queued", "", "u", T0 + dt.timedelta(days=i), T0) for i in range(10)]
    table = spark.createDataFrame(rows, REPORTS)
    asked = spark.createDataFrame([("q1", "u", "0", "B"), ("q2", "u", "5", "A"), ("q3", "u", None, "A"), ("q4", "v", "5", "A")], "request_id string, userId string, reportId string, selectedSymbol string")
    got = {r.request_id: r.report and r.report._id for r in reports.latest_report_for(asked, table).collect()}
    assert got == {"q1": None, "q2": "5", "q3": "9", "q4": None}


def test_state_wins_over_stored_json(spark):
    df = spark.createDataFrame([("{bad", None), ('{"selectedSymbol":"A"}', None), ('{"selectedSymbol":"A"}', (None, None, "B"))], "json string, state struct<generatedAt:string,reportId:string,selectedSymbol:string>")
    assert [r.selectedSymbol for r in preview.parse_preview_request(df, state="state").collect()] == [None, "A", "B"]


def test_failures(spark):
    df = spark.createDataFrame([("ValidationError", "11000", None, "x"), ("E", "11000", 500, "x"), ("MulterError", "LIMIT_FILE_SIZE", None, "x"), ("MulterError", None, None, None), (None, None, 404, "gone"), (None, None, None, None)], "name string, code string, statusCode int, message string")
    assert [r.status for r in validation.classify_failures(df).collect()] == [400, 409, 400, 400, 404, 500]


def test_plans(spark):
    plan = lambda name: catalog.QUERIES[name](spark, TINY)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan("list_prices")
    assert "WindowGroupLimit" in plan("recent_reports")
    assert "Window" not in plan("stock_universe").replace("WindowGroupLimit", "")


@pytest.mark.parametrize("name", ["file_verdict", "file_verdict_by_order"])
def test_file_verdicts_of_whole_rows(spark, name):
    got = catalog.QUERIES[name](spark, TINY).toPandas()
    assert (got.ok & got.error.isna() & (got.rows > 0)).sum() >= 10
    assert ((got.rows == 0) & (got.error == "The uploaded CSV file is empty.")).sum() >= 10
    assert got[~got.ok & (got.rows > 0)].error.str.slice(0, 12).nunique() == 3  # missing, no number, no date
    assert got.rows.sum() == spark.read.parquet(f"{TINY}/lineitem.parquet").count() and got.file.is_unique
    for t in ("lineitem", "orders", "supplier"):
        duckdb.sql(f"create or replace temp view {t} as select * from '{TINY}/{t}.parquet'")
    plain = lambda rows: sorted(map(str, rows))
    want = duckdb.sql("select file, rows, ok, error from (" + catalog.ORACLE[name] + ")").fetchall()
    assert plain(want) == plain((r.file, r.rows, r.ok, r.error) for r in catalog.QUERIES[name](spark, TINY).collect())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_every_query_runs_on_empty_tables(spark, name, tmp_path):
    for table in ("customer", "orders", "events", "lineitem", "supplier"):
        spark.read.parquet(f"{TINY}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    rows = catalog.QUERIES[name](spark, str(tmp_path)).collect()
    assert len(rows) == (1 if name in ("admin_overview", "approximate_overview") else 0)


def test_entry(spark):
    assert not entry.entry(spark).isEmpty()
    assert set(entry.oracle_sql()) <= set(entry.queries())
