"""Every query over the library's own operators, by name, and the SQL that checks it.

All of them read the driver's tables whole, through the adapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from . import adapters as A
from .functions import scalars, validation
from .operators import accounts, browse, layout, prices, reports, search, universe
from .plans import imports, preview
from .schemas import PRICES
from .sources import price_csv
from .storage import save, scratch
from .streaming import jobs

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query, with the SQL that checks it."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _with(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


_PRICES = _with(A.PRICES_SQL)
_USERS = _with(A.USERS_SQL)
_REPORTS = _with(A.REPORTS_SQL)
_RAW = _with(A.RAW_SQL)
_BATCH = _with(A.BATCH_SQL)
_NEWEST = 'order by "tradeDate" desc, "createdAt" desc, _id desc'


# --- newest rows, universe, overview ---------------------------------------------------------------------------------


@query(_with(A.PRICES_SQL, A.UNIVERSE_SQL) + "select * from universe")
def stock_universe(spark: SparkSession, sf: str) -> DataFrame:
    return prices.stock_universe(A.prices(spark, sf))


@query(_PRICES + "select * exclude (rn) from (select *, row_number() over (partition by symbol " + _NEWEST + ") as rn from prices) where rn = 1")
def latest_price_per_symbol(spark: SparkSession, sf: str) -> DataFrame:
    return prices.latest_price_per_symbol(A.prices(spark, sf))


@query(_PRICES + "select * from prices where symbol = 'U5'")
def filter_symbol(spark: SparkSession, sf: str) -> DataFrame:
    return prices.filter_symbol(A.prices(spark, sf), "u5")


@query(_PRICES + "select * from prices where symbol = 'U5' " + _NEWEST + " limit 100")
def list_prices(spark: SparkSession, sf: str) -> DataFrame:
    return prices.list_prices(A.prices(spark, sf), "u5")


@query(_PRICES + "select * from prices " + _NEWEST + " limit 8")
def latest_prices(spark: SparkSession, sf: str) -> DataFrame:
    return prices.latest_prices(A.prices(spark, sf))


@query(
    _with(A.PRICES_SQL, A.USERS_SQL)
    + """select (select count(*) from users where role = 'user') as "userCount", (select count(*) from users where role = 'admin') as "adminCount",
  (select count(*) from prices) as "stockRecordCount", (select count(distinct symbol) from prices) as "exactCount", true as within"""
)
def approximate_overview(spark: SparkSession, sf: str) -> DataFrame:
    """From stored sketches of years; ``within``: the merged estimate is as near to the exact count as is stated."""
    path = f"{scratch(spark, 'sketches')}/years"
    prices.company_sketches(A.prices(spark, sf)).write.parquet(path)
    found = prices.approximate_overview(A.users(spark, sf), spark.read.parquet(path))
    exact = A.prices(spark, sf).agg(F.count_distinct("symbol").alias("exactCount"))
    within = F.abs(F.col("companyCount") - F.col("exactCount")) <= 3 * 1.04 / 2 ** (prices.PRECISION / 2) * F.col("exactCount")
    return found.crossJoin(exact).select("userCount", "adminCount", "stockRecordCount", "exactCount", within.alias("within"))  # one row each


@query(
    _with(
        A.PRICES_SQL,
        """after as (select * exclude (close), case when cast(_id as bigint) % 5 = 0 then close + 1 else close end as close from prices where cast(_id as bigint) % 7 <> 0 and symbol <> 'U7'
  and _id not in (select arg_max(_id, struct_pack(a := "tradeDate", b := "createdAt", c := _id)) from prices where cast(_id as bigint) % 7 <> 0 group by symbol))""",
        A.UNIVERSE_SQL.replace("from prices", "from after"),
    )
    + "select * from universe"
)
def update_universe(spark: SparkSession, sf: str) -> DataFrame:
    """The universe of a part of the table, kept up to date as the rest comes in, rows are edited, and others are deleted, the newest of each symbol at last."""
    p, k = A.prices(spark, sf), F.col("_id").cast("long")
    kind = lambda df, what: df.withColumn("kind", F.lit(what))
    edited = p.withColumn("close", F.when(k % 5 == 0, F.col("close") + 1).otherwise(F.col("close")))
    kept = edited.where((k % 7 != 0) & (F.col("symbol") != "U7"))
    newest = prices.latest_price_per_symbol(edited.where(k % 7 != 0))
    steps = [
        (kind(p.where(k % 3 == 0), "insert"), p),
        (kind(p.where(k % 5 == 0), "delete").unionByName(kind(edited.where(k % 5 == 0), "insert")), edited),
        (kind(edited.where((k % 7 == 0) | ((k % 7 != 0) & (F.col("symbol") == "U7"))), "delete"), kept),
        (kind(newest.where("symbol <> 'U7'"), "delete"), kept.join(newest, "_id", "left_anti")),
    ]
    state = universe.universe_state(p.where(k % 3 != 0))
    for changes, after in steps:
        state = save(universe.update_universe(state, changes, after), "universe")
    return universe.universe_of(state)


@query(
    _with(A.PRICES_SQL, A.USERS_SQL)
    + """select (select count(*) from users where role = 'user') as "userCount", (select count(*) from users where role = 'admin') as "adminCount",
  (select count(*) from prices) as "stockRecordCount", (select count(distinct symbol) from prices) as "companyCount" """
)
def admin_overview(spark: SparkSession, sf: str) -> DataFrame:
    return prices.admin_overview(A.users(spark, sf), A.prices(spark, sf))


@query(
    _PRICES
    + """select _id, symbol, "companyName", strftime("tradeDate", '%Y-%m-%d') as "tradeDate", open, high, low, close,
  coalesce(regexp_replace(cast("adjustedClose" as varchar), '\\.0$', ''), '') as "adjustedClose", volume, notes from prices"""
)
def price_edit_view(spark: SparkSession, sf: str) -> DataFrame:
    return prices.price_edit_view(A.prices(spark, sf))


_SHOWN = "regexp_replace(cast({} as varchar), '\\.0$', '')"


@query(
    _PRICES
    + f"""select _id, "companyName", symbol, strftime("tradeDate", '%Y-%m-%d') as date,
  'O: ' || {_SHOWN.format("open")} || ' | H: ' || {_SHOWN.format("high")} || ' | L: ' || {_SHOWN.format("low")} || ' | C: ' || {_SHOWN.format("close")} as prices,
  {_SHOWN.format("volume")} as volume from prices"""
)
def price_display(spark: SparkSession, sf: str) -> DataFrame:
    return prices.price_display(A.prices(spark, sf))


# --- scalars ---------------------------------------------------------------------------------------------------------


@query(_RAW + "select l_orderkey, l_linenumber, number as value, bad_number as bad from parsed")
def parse_number(spark: SparkSession, sf: str) -> DataFrame:
    return A.raw_cells(spark, sf).select("l_orderkey", "l_linenumber", scalars.parse_number(F.col("price")).alias("p")).select("l_orderkey", "l_linenumber", "p.*")


@query(_RAW + "select l_orderkey, l_linenumber, trade_day as trade_date from parsed")
def parse_trade_date(spark: SparkSession, sf: str) -> DataFrame:
    at = scalars.utc_wall_time(scalars.parse_trade_date(F.col("day")))
    return A.raw_cells(spark, sf).select("l_orderkey", "l_linenumber", at.alias("trade_date"))


@query("select c_custkey, lower(replace(c_name, '#', '.')) || '@mail.test' as email from customer")
def normalize_email(spark: SparkSession, sf: str) -> DataFrame:
    given = F.concat(F.lit(" "), F.upper(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@Mail.TEST  "))
    return A.table(spark, sf, "customer").select("c_custkey", scalars.normalize_email(given).alias("email"))


@query(
    """select o_orderkey, case o_orderkey % 3 when 0 then '17-A-b-' || o_orderkey || '-PDF.pdf' when 1 then '17-A-b-' || o_orderkey || '.pdf' else '17-r-' || o_orderkey || '.pdf' end as stored from orders"""
)
def stored_filename(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("A b "), k, F.lit(".PDF"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("A b "), k, F.lit(".pdf"))).otherwise(F.concat(F.lit("r."), k))
    name = F.when(F.col("o_orderkey") % 3 == 2, F.concat(F.lit("r-"), k)).otherwise(name)
    return A.table(spark, sf, "orders").select("o_orderkey", scalars.stored_filename(name, F.lit(17)).alias("stored"))


@query(
    """select s_suppkey, upper('s' || s_suppkey) as symbol, s_name as "companyName", coalesce(case when s_suppkey % 2 = 0 then 'n' end, '') as notes,
  'csv-upload:f' || s_suppkey || '.csv' as source, cast(s_nationkey as varchar) as "createdBy" from supplier"""
)
def normalize_import(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    given = A.table(spark, sf, "supplier").select(
        "s_suppkey",
        F.concat(F.lit(" s"), k, F.lit("\t")).alias("symbol"),
        F.concat(F.lit(" "), "s_name", F.lit(" ")).alias("companyName"),
        F.when(F.col("s_suppkey") % 2 == 0, " n ").alias("notes"),
        F.concat(F.lit("f"), k, F.lit(".csv")).alias("fileName"),
        F.col("s_nationkey").cast("string").alias("userId"),
    )
    return imports.normalize_import(given).select("s_suppkey", "symbol", "companyName", "notes", "source", "createdBy")


@query("select o_orderkey, coalesce(case when o_orderkey % 2 = 0 then 'x' end, 'manual-entry') as source, coalesce(case when o_orderkey % 3 = 0 then 'admin' end, 'user') as role, coalesce(case when o_orderkey % 5 = 0 then 'failed' end, 'uploaded') as status from orders")
def apply_defaults(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return A.table(spark, sf, "orders").select(
        k,
        scalars.apply_default(F.when(k % 2 == 0, "x"), "manual-entry").alias("source"),
        scalars.apply_default(F.when(k % 3 == 0, "admin"), "user").alias("role"),
        scalars.apply_default(F.when(k % 5 == 0, "failed"), "uploaded").alias("status"),
    )


# --- files and imports -----------------------------------------------------------------------------------------------


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of four kinds of name, up to 11.5 MB."""
    k = F.col("o_orderkey")
    name = F.concat(F.lit("f"), k.cast("string"), F.when(k % 4 == 0, ".csv").when(k % 4 == 1, ".CSV").when(k % 4 == 2, ".pdf").otherwise(".txt"))
    mime = F.when(k % 8 == 3, "application/pdf").otherwise("text/plain")
    return A.table(spark, sf, "orders").select(k, name.alias("name"), F.concat(F.lit("/in/"), name).alias("path"), (F.floor("o_totalprice") * 25).cast("long").alias("length"), mime.alias("mimeType"), F.col("o_custkey"))


_FILES = """files as (select o_orderkey, o_custkey, cast(floor(o_totalprice) as bigint) * 25 as length, 'f' || o_orderkey || case o_orderkey % 4 when 0 then '.csv' when 1 then '.CSV' when 2 then '.pdf' else '.txt' end as name from orders),
judged as (select *, case when o_orderkey % 4 > 1 then 'Please upload a valid file.' when length > 5242880 then 'File upload must be 10MB or smaller.' end as price_reason,
  case when o_orderkey % 4 <> 2 and o_orderkey % 8 <> 3 then 'Please upload a valid file.' when length > 10485760 then 'File upload must be 10MB or smaller.' end as report_reason from files)"""


@query(_with(_FILES) + "select o_orderkey, name, price_reason is null as price_ok, price_reason, report_reason is null as report_ok, report_reason from judged")
def accept_files(spark: SparkSession, sf: str) -> DataFrame:
    once = price_csv.accept_files(_files(spark, sf), "prices").withColumnsRenamed({"accepted": "price_ok", "reject_reason": "price_reason"})
    both = price_csv.accept_files(once, "report").withColumnsRenamed({"accepted": "report_ok", "reject_reason": "report_reason"})
    return both.select("o_orderkey", "name", "price_ok", "price_reason", "report_ok", "report_reason")


def _intake(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    files = price_csv.accept_files(_files(spark, sf), "report")
    k = F.col("o_orderkey")
    uploads = files.select(
        "path",
        F.col("name").alias("originalFilename"),
        "mimeType",
        F.when(k % 9 == 0, " ").otherwise(F.concat(F.lit(" u"), (k % 20).cast("string"))).alias("symbol"),
        F.concat(F.lit("Company "), (k % 20).cast("string")).alias("companyName"),
        F.col("o_custkey").cast("string").alias("userId"),
        F.lit(17).alias("epoch_ms"),
    )
    return reports.report_intake(files.where(k % 10 != 4).select("path", "length", "accepted", "reject_reason"), uploads, A.as_of())


@query(
    _with(_FILES)
    + """select '/in/' || name as "storagePath", 'U' || (o_orderkey % 20) as "stockSymbol", 'Company ' || (o_orderkey % 20) as "companyName", length as "sizeBytes", 'queued' as "processingStatus",
  '17-f' || o_orderkey || case o_orderkey % 4 when 2 then '.pdf' else '.txt' end as "storedFilename", cast(o_custkey as varchar) as "uploadedBy" from judged where report_reason is null and o_orderkey % 9 <> 0 and o_orderkey % 10 <> 4"""
)
def report_intake(spark: SparkSession, sf: str) -> DataFrame:
    return _intake(spark, sf)[0].select("storagePath", "stockSymbol", "companyName", "sizeBytes", "processingStatus", "storedFilename", "uploadedBy")


@query(
    _with(_FILES)
    + """select '/in/' || name as path, 400 as status, case when o_orderkey % 10 <> 4 and report_reason is not null then report_reason when o_orderkey % 9 = 0 then 'Company name and stock symbol are required.' else 'Please upload a PDF report.' end as message
  from judged where report_reason is not null or o_orderkey % 9 = 0 or o_orderkey % 10 = 4"""
)
def report_intake_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return _intake(spark, sf)[1]


def _headed(spark: SparkSession, sf: str) -> DataFrame:
    """Cells under headers of several spellings."""
    blank = lambda n, c: F.when(F.col("l_linenumber") == n, "").otherwise(F.col(c))
    raw = A.raw_cells(spark, sf).select("l_orderkey", "l_linenumber", blank(1, "day").alias("_c0"), F.col("l_orderkey").cast("string").alias("_c1"), F.lit("9").alias("_c2"), blank(2, "price").alias("_c3"), F.col("plain").alias("_c4"))
    return price_csv.resolve_price_columns(raw, ["Trade Date", "date", "OPEN", "Opening-Price", "open"], ["_c0", "_c1", "_c2", "_c3", "_c4"], ["l_orderkey", "l_linenumber"])


@query(
    _RAW
    + """select l_orderkey, l_linenumber, coalesce(nullif(case when l_linenumber = 1 then '' else day end, ''), cast(l_orderkey as varchar)) as "tradeDate",
  coalesce(nullif(plain, ''), nullif(case when l_linenumber = 2 then '' else price end, '')) as open from raw"""
)
def resolve_price_columns(spark: SparkSession, sf: str) -> DataFrame:
    return _headed(spark, sf).select("l_orderkey", "l_linenumber", "tradeDate", "open")


def _csv_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    blank = scalars.blank_to_null
    return A.raw_cells(spark, sf).select(
        c("l_suppkey").alias("file"),
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("row_idx"),
        "l_partkey",
        blank(c("day")).alias("tradeDate"),
        blank(c("price")).alias("open"),
        *(F.lit("1").alias(x) for x in ("high", "low", "close")),
        blank(F.when(c("plain") == "1d", "1d").otherwise("")).alias("adjustedClose"),
        blank(F.when(c("plain") == "", "").otherwise("5")).alias("volume"),
    )


_CHECKED = """rows as (select l_suppkey as file, l_orderkey * 10 + l_linenumber as row_idx, l_partkey, case
  when day = '' then 'Missing required CSV column. Expected one of: tradeDate, date, tradingDate'
  when price = '' then 'Missing required CSV column. Expected one of: open, openingPrice'
  when bad_number then 'Invalid numeric value "12x" found in CSV.'
  when plain = '1d' then 'Invalid numeric value "1d" found in CSV.'
  when plain = '' then 'Missing required CSV column. Expected one of: volume, tradeVolume'
  when day = 'soon' then 'Invalid trade date at CSV row ' || (l_orderkey * 10 + l_linenumber + 2) || '.' end as error from parsed)"""


@query(_with(A.RAW_SQL, _CHECKED) + "select file, row_idx, l_partkey, error from rows")
def check_csv_rows(spark: SparkSession, sf: str) -> DataFrame:
    return validation.check_csv_rows(_csv_rows(spark, sf)).select("file", "row_idx", "l_partkey", "error")


@query(
    _with(A.RAW_SQL, _CHECKED)
    + """, files as (select distinct l_partkey as file from lineitem union all select -1 - s_suppkey from supplier),
ranked as (select f.file, r.error, count(r.row_idx) over (partition by f.file) as rows,
  row_number() over (partition by f.file order by (r.error is null), r.row_idx) as rn from files f left join rows r on r.l_partkey = f.file)
select file, rows, case when rows = 0 then 'The uploaded CSV file is empty.' else error end as error, rows > 0 and error is null as ok from ranked where rn = 1"""
)
def file_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of lineitem, a file a part, and a file without rows for each supplier."""
    rows = validation.check_csv_rows(_csv_rows(spark, sf)).withColumn("file", F.col("l_partkey"))
    files = rows.select("file").distinct().union(A.table(spark, sf, "supplier").select(-1 - F.col("s_suppkey")))
    return price_csv.file_verdict(rows, files)


@query(
    _with(
        A.RAW_SQL,
        """numbered as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) - 1 as row_idx from parsed)""",
        """judged as (select l_orderkey as file, row_idx, case
  when day = '' then 'Missing required CSV column. Expected one of: tradeDate, date, tradingDate'
  when price = '' then 'Missing required CSV column. Expected one of: open, openingPrice'
  when bad_number then 'Invalid numeric value "12x" found in CSV.'
  when plain = '1d' then 'Invalid numeric value "1d" found in CSV.'
  when plain = '' then 'Missing required CSV column. Expected one of: volume, tradeVolume'
  when day = 'soon' then 'Invalid trade date at CSV row ' || (row_idx + 2) || '.' end as error from numbered)""",
        """ranked as (select o_orderkey as file, j.error, count(row_idx) over (partition by o_orderkey) as rows,
  row_number() over (partition by o_orderkey order by (j.error is null), row_idx) as rn from orders left join judged j on j.file = o_orderkey)""",
    )
    + "select file, rows, rows > 0 and error is null as ok, case when rows = 0 then 'The uploaded CSV file is empty.' else error end as error from ranked where rn = 1"
)
def file_verdict_by_order(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of lineitem, a file an order; some orders have no row."""
    # row_idx is the place within the file; rows of one line number and part have the same cells to judge
    place = F.row_number().over(Window.partitionBy("file").orderBy("row_idx", "l_partkey")) - 1
    rows = _csv_rows(spark, sf).withColumn("file", F.floor(F.col("row_idx") / 10)).withColumn("row_idx", place.cast("long"))
    return price_csv.file_verdict(validation.check_csv_rows(rows), A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("file")))


_CSV_CELLS = ["tradeDate", "open", "high", "low", "close", "adjustedClose", "volume"]


@query(
    _RAW
    + """select nullif(day, '') as "tradeDate", nullif(price, '') as open, '1' as high, '2' as low, nullif(plain, '') as close,
  case when l_orderkey % 2 = 0 then nullif(price, '') end as "adjustedClose", cast(l_orderkey * 10 + l_linenumber as varchar) as volume, count(*) as same from raw group by all"""
)
def read_price_csv(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of lineitem written as price files with headers of two spellings, and read back."""
    c, odd = F.col, F.col("l_orderkey") % 2 == 1
    raw = A.raw_cells(spark, sf)
    cells = [c("day"), c("price"), F.lit("1"), F.lit("2"), c("plain"), c("price"), (c("l_orderkey") * 10 + c("l_linenumber")).cast("string")]
    folder = scratch(spark, "csv")
    plain = raw.where(~odd).select(*(v.alias(n) for v, n in zip(cells, _CSV_CELLS, strict=True)))
    other = raw.where(odd).select(*(v.alias(n) for v, n in zip(cells[:5] + cells[6:], ["Date", "OPEN", "High Price", "low-price", "Closing Price", "TRADE_VOLUME"], strict=True)))
    for name, rows in (("plain", plain), ("other", other)):
        rows.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(f"{folder}/{name}")
    files = price_csv.list_files(spark, folder).where(F.col("name").endswith(".csv"))
    read = price_csv.read_price_csv(spark, [r.path for r in files.select("path").collect()])
    return read.groupBy(*_CSV_CELLS).agg(F.count("*").alias("same"))


@query(_PRICES + """select *, year("tradeDate")::integer as trade_year from prices""")
def write_prices(spark: SparkSession, sf: str) -> DataFrame:
    """The price table written by year of trade, and read back."""
    path = f"{scratch(spark, 'prices')}/table"
    layout.write_prices(A.prices(spark, sf), path)
    return spark.read.schema(StructType([*PRICES.fields, StructField("trade_year", IntegerType())])).parquet(path)


@query(_PRICES + "select * from prices where symbol = 'U5'")
def read_symbol(spark: SparkSession, sf: str) -> DataFrame:
    """One symbol's rows from the whole table as it is written, of which few files are opened."""
    path = f"{scratch(spark, 'prices')}/table"
    layout.write_prices(A.prices(spark, sf), path)
    return layout.read_symbol(spark, path, "u5")


@query(
    _with(
        A.PRICES_SQL,
        """filed as (select symbol, "tradeDate", close + 1 as close, volume from prices where notes <> 'error')""",
        """before as (select * from prices where notes <> 'view')""",
    )
    + f"""select symbol, "tradeDate", case when f.close is null then b._id end as old_id, coalesce(f.close, b.close) as close,
  case when f.close is null then b."adjustedClose" end as "adjustedClose", coalesce(f.volume, b.volume) as volume,
  case when f.close is null then b."companyName" else 'Company ' || symbol end as "companyName",
  case when f.close is null then b."updatedAt" else timestamp '{A.AS_OF}' end as "updatedAt"
  from filed f full join before b using (symbol, "tradeDate")"""
)
def stream_price_imports(spark: SparkSession, sf: str) -> DataFrame:
    """Prices in a table, a file of later ones for each symbol, imported as they arrive, and the table that comes of it."""
    all_, folder = A.prices(spark, sf), scratch(spark, "stream")
    table = f"{folder}/table"
    jobs.start_table(all_.where("notes <> 'view'"), table)
    day = F.date_format("tradeDate", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    same = [F.lit("1").alias(c) for c in ("open", "high", "low")]
    cells = all_.where("notes <> 'error'").select("symbol", day.alias("Trade Date"), *same, (F.col("close") + 1).cast("string").alias("Close"), F.col("volume").cast("string").alias("volume"))
    cells.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "symbol").write.partitionBy("symbol").option("header", True).csv(f"{folder}/in")
    files = price_csv.list_files(spark, f"{folder}/in").where(F.col("name").endswith(".csv"))
    symbol = F.regexp_extract("path", r"symbol=([^/]+)/", 1)
    uploads = files.select(
        symbol.alias("upload_id"), F.lit(1).alias("upload_seq"), "path", "length", F.col("name").alias("fileName"), symbol.alias("symbol"),
        F.concat(F.lit("Company "), symbol).alias("companyName"), F.lit("from a file").alias("notes"), F.lit("u").alias("userId"),
    )
    uploads = save(uploads, "uploads")  # a table of its own: each lot reads it
    jobs.stream_price_imports(spark, f"{folder}/in", uploads, table, f"{folder}/state", A.as_of()).awaitTermination()
    done = jobs.read_table(spark, table)
    return done.select("symbol", "tradeDate", F.when(F.col("updatedAt") < A.as_of(), F.col("_id")).alias("old_id"), "close", "adjustedClose", "volume", "companyName", "updatedAt")


# --- checks ----------------------------------------------------------------------------------------------------------


def _edits(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return A.raw_cells(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        c("named").alias("symbol"), F.lit("Company").alias("companyName"), c("day").alias("tradeDate"), c("plain").alias("open"),
        F.lit("1").alias("high"), F.lit("1.5e1").alias("low"), F.lit(".5").alias("close"), c("plain").alias("adjustedClose"), F.lit("3").alias("volume"),
        F.when(c("l_linenumber") == 6, F.repeat(F.lit("n"), 301)).otherwise("ok").alias("notes"),
    )


_CODED = "array_to_string(list_filter([{}], lambda x: x is not null), '; ')"
_EDIT_ERRORS = _CODED.format(
    """case when l_partkey % 50 = 12 then 'symbol: Symbol must be between 2 and 20 characters.' end,
  case when l_partkey % 50 between 5 and 8 then 'tradeDate: Enter a valid trade date.' end,
  case when l_partkey % 50 between 9 and 11 then 'open: Open price must be a non-negative number.' end,
  case when l_partkey % 50 between 9 and 10 then 'adjustedClose: Adjusted close must be a non-negative number.' end,
  case when l_linenumber = 6 then 'notes: Notes cannot exceed 300 characters.' end"""
)


def _coded(df: DataFrame, *keys: str) -> DataFrame:
    """Errors as one text."""
    return df.select(*keys, F.array_join(F.transform("errors", lambda e: F.concat_ws(": ", e["field"], e["message"])), "; ").alias("errors"))


@query(_RAW + f"select l_orderkey, l_linenumber, l_partkey, {_EDIT_ERRORS} as errors from raw")
def validate_prices(spark: SparkSession, sf: str) -> DataFrame:
    return _coded(validation.validate_prices(_edits(spark, sf)), "l_orderkey", "l_linenumber", "l_partkey")


@query(
    _USERS
    + "select _id, "
    + _CODED.format("case when cast(_id as bigint) % 7 = 0 then 'name: Name must be 2 to 80 characters.' end, case when cast(_id as bigint) % 5 = 0 then 'email: Enter a valid email address.' end, case when cast(_id as bigint) % 3 = 0 then 'role: Role must be either admin or user.' end")
    + " as errors from users"
)
def validate_users(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("_id").cast("long")
    given = A.users(spark, sf).withColumns({"name": F.when(k % 7 == 0, " x ").otherwise(F.col("name")), "email": F.when(k % 5 == 0, "x@y").otherwise(F.col("email")), "role": F.when(k % 3 == 0, F.lit(None)).otherwise(F.col("role"))})
    return _coded(validation.validate_users(given), "_id")


@query(
    _REPORTS
    + "select _id, "
    + _CODED.format("case when cast(_id as bigint) % 7 = 0 then 'symbol: Symbol must be between 2 and 20 characters.' end, case when cast(_id as bigint) % 5 = 0 then 'sizeBytes: Size must be at least 1 byte.' end, case when cast(_id as bigint) % 3 = 0 then 'processingStatus: Unknown processing status.' end")
    + " as errors from reports"
)
def validate_reports(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("_id").cast("long")
    given = A.reports(spark, sf).withColumns({"stockSymbol": F.when(k % 7 == 0, "x").otherwise(F.col("stockSymbol")), "sizeBytes": F.when(k % 5 == 0, 0).otherwise(F.col("sizeBytes")), "processingStatus": F.when(k % 3 == 0, "lost").otherwise(F.col("processingStatus"))})
    return _coded(validation.validate_reports(given), "_id")


@query("select s_suppkey, " + _CODED.format("case when s_suppkey % 3 = 0 then 'symbol: Symbol must be between 2 and 20 characters.' end, case when s_suppkey % 5 = 0 then 'companyName: Company name must be between 2 and 120 characters.' end, case when s_suppkey % 7 = 0 then 'notes: Notes cannot exceed 300 characters.' end") + " as errors from supplier")
def validate_import_header(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    given = A.table(spark, sf, "supplier").select(k, F.when(k % 3 == 0, " a ").otherwise("ab").alias("symbol"), F.when(k % 5 == 0, F.repeat(F.lit("c"), 121)).otherwise(F.col("s_name")).alias("companyName"), F.when(k % 7 == 0, F.repeat(F.lit("n"), 301)).alias("notes"))
    return _coded(validation.validate_import_header(given), "s_suppkey")


@query(_RAW + f", e as (select l_suppkey as key, unnest(string_split({_EDIT_ERRORS}, '; ')) as e from raw) select key, count(*) as messages, count(distinct e) as kinds from e where e <> '' group by key")
def collect_errors(spark: SparkSession, sf: str) -> DataFrame:
    found = validation.collect_errors(validation.validate_prices(_edits(spark, sf)), "l_suppkey")
    return found.select("key", F.size("messages").cast("long").alias("messages"), F.size(F.array_distinct("messages")).cast("long").alias("kinds"))


@query(
    """select event_id, case event_type when 'click' then 400 when 'error' then 409 when 'view' then 400 else case when user_id % 2 = 0 then 404 else 500 end end as status,
  case event_type when 'click' then 'Validation failed.' when 'error' then 'A record with this unique value already exists.'
   when 'view' then case when user_id % 2 = 0 then 'File upload must be 10MB or smaller.' else 'Please upload a valid file.' end
   else case when user_id % 3 = 0 then 'Stock record not found.' else 'Internal server error.' end end as answer from events"""
)
def classify_failures(spark: SparkSession, sf: str) -> DataFrame:
    kind, even = F.col("event_type"), F.col("user_id") % 2 == 0
    given = A.table(spark, sf, "events").select(
        "event_id",
        F.when(kind == "click", "ValidationError").when(kind == "view", "MulterError").otherwise("Error").alias("name"),
        F.when(kind == "error", "11000").when((kind == "view") & even, "LIMIT_FILE_SIZE").alias("code"),
        F.when(even, 404).alias("statusCode"),
        F.when(F.col("user_id") % 3 == 0, "Stock record not found.").otherwise("").alias("message"),
    )
    return validation.classify_failures(given).select("event_id", "status", "answer")


# --- merges of prices ------------------------------------------------------------------------------------------------

_WINNERS = """w as (select * from (select *, row_number() over (partition by symbol, "tradeDate" order by upload_seq desc, row_idx desc) as rn from incoming) where rn = 1)"""


@query(
    _with(A.BATCH_SQL, _WINNERS)
    + f"""select symbol, "tradeDate", e._id as old_id, case when w.rn is null then e."companyName" else w."companyName" end as "companyName",
  case when w.rn is null then e.close else w.close end as close, case when w.rn is null then e."adjustedClose" else w."adjustedClose" end as "adjustedClose",
  case when w.rn is null then e.volume else w.volume end as volume, case when w.rn is null then e.notes else w.notes end as notes,
  coalesce(e."createdAt", timestamp '{A.AS_OF}') as "createdAt", case when w.rn is null then e."updatedAt" else timestamp '{A.AS_OF}' end as "updatedAt"
  from existing e full join w using (symbol, "tradeDate")"""
)
def upsert_prices(spark: SparkSession, sf: str) -> DataFrame:
    merged = prices.upsert_prices(*A.price_batch(spark, sf), A.as_of())
    old = F.when(F.length("_id") < 24, F.col("_id"))
    return merged.select("symbol", "tradeDate", old.alias("old_id"), "companyName", "close", "adjustedClose", "volume", "notes", "createdAt", "updatedAt")


@query(
    _with(A.BATCH_SQL)
    + """, r as (select i.upload_id, e._id is null and row_number() over (partition by i.symbol, i."tradeDate" order by upload_seq, row_idx) = 1 as added
  from incoming i left join existing e on e.symbol = i.symbol and e."tradeDate" = i."tradeDate")
select upload_id, count(*) filter (not added) as matched, count(*) filter (not added) as modified, count(*) filter (added) as upserted, count(*) as "totalRows" from r group by 1"""
)
def import_summary(spark: SparkSession, sf: str) -> DataFrame:
    return prices.import_summary(*A.price_batch(spark, sf))


@query(_with(A.BATCH_SQL, _WINNERS) + 'select symbol, "tradeDate", upload_id, row_idx, close, notes from w')
def dedupe_batch(spark: SparkSession, sf: str) -> DataFrame:
    kept = prices.dedupe_batch(A.price_batch(spark, sf)[1], prices.KEY, ["upload_seq", "row_idx"])
    return kept.select("symbol", "tradeDate", "upload_id", "row_idx", "close", "notes")


def _price_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Edits of each row, two of some: to a day of its own, to the day of another row, broken, or, of two thirds of the rows, of no row."""
    p, k = A.prices(spark, sf), F.col("_id").cast("long")
    base = p.select(
        k.alias("edit_seq"),
        F.when((k % 27 == 0) | (k % 3 != 0), F.concat(F.lit("none-"), F.col("_id"))).otherwise(F.col("_id")).alias("_id"),
        F.when(k % 21 == 0, "x").otherwise(F.concat(F.lit(" e"), F.col("_id"))).alias("symbol"),
        F.lit(" Edited ").alias("companyName"),
        F.lit("2026-01-02").alias("tradeDate"),
        *(F.lit(v).alias(c) for c, v in (("open", "1"), ("high", "2.5"), ("low", "0"), ("close", "2"), ("adjustedClose", ""), ("volume", "7"))),
        F.lit(" n ").alias("notes"),
    )
    again = base.where("edit_seq % 5 = 0").withColumns({"edit_seq": F.col("edit_seq") + 10**12, "close": F.lit("3")})
    shared = base.where("edit_seq % 4 = 0 and edit_seq % 21 <> 0 and edit_seq % 27 <> 0").withColumns({"edit_seq": F.col("edit_seq") + 10**13, "symbol": F.concat(F.lit("shared"), (F.col("edit_seq") % 1000).cast("string"))})
    return base.unionByName(again).unionByName(shared)


_EDITS = """b as (select cast(_id as bigint) as k, _id from prices),
edits as (select k as seq, k, 'E' || _id as symbol, 2.0 as close from b union all select k + 1000000000000, k, 'E' || _id, 3.0 from b where k % 5 = 0
  union all select k + 10000000000000, k, 'SHARED' || (k % 1000), 2.0 from b where k % 4 = 0 and k % 21 <> 0 and k % 27 <> 0),
j as (select *, case when k % 21 = 0 then 400 when k % 27 = 0 or k % 3 <> 0 then 404 when symbol like 'SHARED%' and k <> min(case when k % 3 = 0 then k end) over (partition by symbol) then 409 else 200 end as status,
  max(case when k % 3 = 0 and k % 21 <> 0 and k % 27 <> 0 then seq end) over (partition by k) as last from edits)"""


@query(
    _with(A.PRICES_SQL, _EDITS)
    + f""", a as (select * from j where status = 200 and seq = last)
select _id, coalesce(a.symbol, p.symbol) as symbol, case when a.k is null then p."companyName" else 'Edited' end as "companyName",
  case when a.k is null then p."tradeDate" else timestamp '2026-01-02' end as "tradeDate", coalesce(a.close, p.close) as close,
  case when a.k is null then p."adjustedClose" end as "adjustedClose", case when a.k is null then p.notes else 'n' end as notes,
  case when a.k is null then p."updatedAt" else timestamp '{A.AS_OF}' end as "updatedAt" from prices p left join a on a.k = cast(p._id as bigint)"""
)
def apply_price_edits(spark: SparkSession, sf: str) -> DataFrame:
    done = prices.apply_price_edits(A.prices(spark, sf), _price_edits(spark, sf), A.as_of())[0]
    return done.select("_id", "symbol", "companyName", "tradeDate", "close", "adjustedClose", "notes", "updatedAt")


@query(_with(A.PRICES_SQL, _EDITS) + "select seq as edit_seq, status, case status when 400 then 'Please correct the highlighted input errors.' when 404 then 'Stock record not found.' else 'A record with this unique value already exists.' end as message from j where status <> 200")
def apply_price_edits_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return prices.apply_price_edits(A.prices(spark, sf), _price_edits(spark, sf), A.as_of())[1].select("edit_seq", "status", "message")


def _chained(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All prices, with a symbol of their own on one day, and three edits of each: along a ring of 20 rows that one row
    leaves, two places on, and to a neighbour's key; some broken, some of no row."""
    p = A.prices(spark, sf).withColumns({"symbol": F.concat(F.lit("P"), F.col("_id")), "tradeDate": F.lit("2026-01-02").cast("timestamp_ntz")})
    k = F.col("_id").cast("long")
    ring, place = F.floor(k / 20), k % 20
    at = lambda n: F.concat(F.lit(" p"), (ring * 20 + (place + n) % 20).cast("string"))
    passes = [
        F.when(place == 13, F.concat(F.lit("free"), F.col("_id"))).otherwise(at(1)),
        F.when(k % 21 == 0, "x").when(k % 5 == 0, at(0)).otherwise(at(2)),
        F.concat(F.lit("P"), k.bitwiseXOR(F.lit(1)).cast("string")),
    ]
    edits = [
        p.select(
            ((n * 20 + (place * 7 + 3 * n) % 20) * 10**9 + ring).alias("edit_seq"),
            F.when((k % 27 == 0) & (F.lit(n) == 2), F.concat(F.lit("none-"), F.col("_id"))).otherwise(F.col("_id")).alias("_id"),
            symbol.alias("symbol"), F.lit(" Edited ").alias("companyName"), F.lit("2026-01-02").alias("tradeDate"),
            *(F.lit(v).alias(c) for c, v in (("open", "1"), ("high", "2.5"), ("low", "0"), ("close", str(n)), ("adjustedClose", ""), ("volume", "7"))), F.lit("").alias("notes"),
        )
        for n, symbol in enumerate(passes)
    ]
    return p, edits[0].unionByName(edits[1]).unionByName(edits[2])


def _replayed(has: str, edits: str) -> str:
    """Recursive SQL: per group g, claim by claim, with the keys that the rows of the group have.

    has: (g, r, key); edits: (g, seq, r, key, valid, found)."""
    return f"""has as ({has}), edits as ({edits}),
claims as (select *, row_number() over (partition by g order by seq) as i from edits where valid and found),
state(g, i, held, seq, ok) as (select g, 0::bigint, list({{'r': r, 'key': key}}), null::bigint, null::boolean from has group by g union all
  select g, i, case when ok then list_transform(held, lambda x: case when x.r = r then {{'r': r, 'key': key}} else x end) else held end, seq, ok
  from (select c.*, s.held, len(list_filter(s.held, lambda x: x.key = c.key and x.r <> c.r)) = 0 as ok from state s join claims c on c.g = s.g and c.i = s.i + 1)),
judged as (select e.*, case when not valid then 400 when not found then 404 when not s.ok then 409 else 200 end as status from edits e left join state s on s.seq = e.seq),
applied as (select * from (select *, row_number() over (partition by r order by seq desc) as back from judged where status = 200) where back = 1)"""


_CHAINED = "with recursive " + A.PRICES_SQL + ", k as (select cast(_id as bigint) as k, cast(_id as bigint) // 20 as g, cast(_id as bigint) % 20 as at_ from prices),\n" + _replayed(
    "select g, k as r, 'P' || k as key from k",
    """select g, (n * 20 + (at_ * 7 + 3 * n) % 20) * 1000000000 + g as seq, k as r, not (n = 1 and k % 21 = 0) as valid, not (n = 2 and k % 27 = 0) as found, n,
  case n when 0 then case when at_ = 13 then 'FREE' || k else 'P' || (g * 20 + (at_ + 1) % 20) end when 1 then 'P' || (g * 20 + (at_ + case when k % 5 = 0 then 0 else 2 end) % 20) else 'P' || xor(k, 1) end as key
  from k, (select unnest([0, 1, 2])::bigint as n)""",
)


@query(_CHAINED + """ select p._id, coalesce(a.key, 'P' || p._id) as symbol, case when a.r is null then p.close else a.n end as close, case when a.r is null then p."companyName" else 'Edited' end as "companyName" from prices p left join applied a on a.r = cast(p._id as bigint)""")
def replay_price_edits(spark: SparkSession, sf: str) -> DataFrame:
    return prices.replay_price_edits(*_chained(spark, sf), A.as_of())[0].select("_id", "symbol", "close", "companyName")


@query(_CHAINED + " select seq as edit_seq, case when n = 2 and r % 27 = 0 then 'none-' || r else cast(r as varchar) end as _id, status from judged where status <> 200")
def replay_price_edits_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return prices.replay_price_edits(*_chained(spark, sf), A.as_of())[1].select("edit_seq", "_id", "status")


def _price_deletes(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "events").select(F.when(F.col("event_id") % 8 == 0, F.col("event_id").cast("string")).otherwise(F.concat(F.lit("x"), F.col("event_id").cast("string"))).alias("_id"))


@query(_PRICES + "select * from prices where cast(_id as bigint) % 8 <> 0")
def delete_prices(spark: SparkSession, sf: str) -> DataFrame:
    return prices.delete_prices(A.prices(spark, sf), _price_deletes(spark, sf))[0]


@query("select 'x' || event_id as _id, 404 as status, 'Stock record not found.' as message from events where event_id % 8 <> 0")
def delete_prices_not_found(spark: SparkSession, sf: str) -> DataFrame:
    return prices.delete_prices(A.prices(spark, sf), _price_deletes(spark, sf))[1]


# --- accounts --------------------------------------------------------------------------------------------------------


@query(_USERS + "select * from users where role in ('admin')")
def filter_role(spark: SparkSession, sf: str) -> DataFrame:
    return accounts.filter_role(A.users(spark, sf), "admin")


@query(_USERS + 'select _id, name, email, role, "createdAt", "lastLoginAt", "updatedAt" from users')
def list_users(spark: SparkSession, sf: str) -> DataFrame:
    return accounts.list_users(A.users(spark, sf))


@query(_USERS + 'select _id, name, email, role, "createdAt" from users')
def user_public(spark: SparkSession, sf: str) -> DataFrame:
    return accounts.user_public(A.users(spark, sf))


@query(_REPORTS + 'select _id, "stockSymbol", "companyName", "originalFilename", "mimeType", "sizeBytes", "processingStatus", summary, "createdAt" as "uploadedAt" from reports')
def report_public(spark: SparkSession, sf: str) -> DataFrame:
    return reports.report_public(A.reports(spark, sf))


def _registrations(spark: SparkSession, sf: str) -> DataFrame:
    """Per order a request: of a known customer, of a new e-mail that ten requests share, or a broken one."""
    k = F.col("o_orderkey")
    known = F.concat(F.lit(" Customer."), F.lpad((k % 1500).cast("string"), 9, "0"), F.lit("@mail.test"))
    fresh = F.concat(F.lit("New."), F.floor(k / 10).cast("string"), F.lit("@Mail.test "))
    return A.table(spark, sf, "orders").select(
        k.alias("seq"),
        F.lit(" Some One ").alias("name"),
        F.when(k % 7 == 0, "broken").when(k % 2 == 0, known).otherwise(fresh).alias("email"),
        F.when(k % 3 == 0, "admin").otherwise("user").alias("role"),
        F.when(k % 5 == 0, "seed").when(k % 5 == 1, "self").otherwise("admin").alias("kind"),
    )


_ASKED = """asked as (select o_orderkey as seq, case when o_orderkey % 7 = 0 then 'broken' when o_orderkey % 2 = 0 then 'customer.' || lpad(cast(o_orderkey % 1500 as varchar), 9, '0') || '@mail.test'
   else 'new.' || (o_orderkey // 10) || '@mail.test' end as email, case when o_orderkey % 5 = 0 then 'admin' when o_orderkey % 5 = 1 then 'user' when o_orderkey % 3 = 0 then 'admin' else 'user' end as role,
   o_orderkey % 5 = 0 as seeded, o_orderkey % 7 <> 0 as valid from orders),
judged as (select *, case when not valid then 400 when seq = min(case when valid then seq end) over (partition by email) and email not in (select email from users) then 201 when seeded then 200 else 409 end as status from asked)"""


@query(_with(A.USERS_SQL, _ASKED) + f"""select email, name, role, "lastLoginAt", "createdAt" from users union all select email, 'Some One', role, null, timestamp '{A.AS_OF}' from judged where status = 201""")
def register_users(spark: SparkSession, sf: str) -> DataFrame:
    return accounts.register_users(A.users(spark, sf), _registrations(spark, sf), A.as_of())[0].select("email", "name", "role", "lastLoginAt", "createdAt")


@query(_with(A.USERS_SQL, _ASKED) + "select seq, email, status, case status when 400 then 'Please correct the highlighted input errors.' else 'An account already exists for this email.' end as message from judged where status >= 400")
def register_users_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return accounts.register_users(A.users(spark, sf), _registrations(spark, sf), A.as_of())[1]


@query(_with(A.USERS_SQL, _ASKED) + "select seq, email from (select *, row_number() over (partition by email order by seq) as rn from asked) where rn = 1")
def first_per_email(spark: SparkSession, sf: str) -> DataFrame:
    return accounts.first_per_email(_registrations(spark, sf)).select("seq", "email")


def _user_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Per order an edit of its customer: to an e-mail of the customer's own, of the next customer, or shared by many."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    mail = lambda n: F.concat(F.lit("Customer."), F.lpad(n.cast("string"), 9, "0"), F.lit("@mail.test"))
    email = F.when(k % 4 == 0, mail(c)).when(k % 4 == 1, mail(F.lit(0))).when(k % 4 == 2, F.concat(F.lit("shared."), (k % 50).cast("string"), F.lit("@mail.test"))).otherwise(F.concat(F.lit("own."), c.cast("string"), F.lit("@mail.test")))
    return A.table(spark, sf, "orders").select(
        k.alias("seq"),
        F.when(k % 9 == 0, F.concat(F.lit("none-"), c.cast("string"))).otherwise(c.cast("string")).alias("_id"),
        F.lit(" New Name ").alias("name"),
        email.alias("email"),
        F.when(k % 11 == 0, "owner").otherwise("user").alias("role"),
    )


_USER_EDITS = """edits as (select o_orderkey as seq, o_custkey as c, case when o_orderkey % 9 = 0 then 'none-' || o_custkey else cast(o_custkey as varchar) end as _id,
   case o_orderkey % 4 when 0 then 'customer.' || lpad(cast(o_custkey as varchar), 9, '0') || '@mail.test' when 1 then 'customer.000000000@mail.test' when 2 then 'shared.' || (o_orderkey % 50) || '@mail.test' else 'own.' || o_custkey || '@mail.test' end as email,
   o_orderkey % 11 <> 0 as valid from orders),
k as (select e.*, u._id is not null as found, valid and u._id is not null and (o._id is null or o._id = e._id) as good from edits e left join users u on u._id = e._id left join users o on o.email = e.email),
j as (select *, good and first_value(_id) over (partition by email order by good desc, seq) <> _id as second, max(case when good then seq end) over (partition by _id) as last from k),
judged as (select *, case when not valid then 400 when not found then 404 when not good or second then 409 else 200 end as status from j)"""


@query(
    _with(A.USERS_SQL, _USER_EDITS)
    + f""", a as (select * from judged where status = 200 and seq = last)
select u._id, case when a.c is null then u.name else 'New Name' end as name, coalesce(a.email, u.email) as email, case when a.c is null then u.role else 'user' end as role,
  case when a.c is null then u."updatedAt" else timestamp '{A.AS_OF}' end as "updatedAt" from users u left join a on a._id = u._id"""
)
def update_users(spark: SparkSession, sf: str) -> DataFrame:
    return accounts.update_users(A.users(spark, sf), _user_edits(spark, sf), A.as_of())[0].select("_id", "name", "email", "role", "updatedAt")


@query(_with(A.USERS_SQL, _USER_EDITS) + "select seq, _id, status, case status when 400 then 'Please correct the highlighted input errors.' when 404 then 'User not found.' else 'Another account already uses this email.' end as message from judged where status <> 200")
def update_users_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return accounts.update_users(A.users(spark, sf), _user_edits(spark, sf), A.as_of())[1]


def _mailbox_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Per order an edit of its customer, who are ten to a block: to an e-mail that some customer of the block had at first, to
    one that the block shares, to one of their own."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    block = F.floor(c / 10)
    first = lambda n: F.concat(F.lit("Customer."), F.lpad(n.cast("string"), 9, "0"), F.lit("@mail.test"))
    email = F.when(k % 4 == 0, first(block * 10 + k % 10)).when(k % 4 == 1, F.concat(F.lit("block."), block.cast("string"), F.lit("@mail.test")))
    email = email.when(k % 4 == 2, first(block * 10 + (c + 1) % 10)).otherwise(F.concat(F.lit("own."), c.cast("string"), F.lit("@mail.test")))
    target = F.when(k % 9 == 0, F.concat(F.lit("none-"), c.cast("string"))).otherwise(c.cast("string"))
    return A.table(spark, sf, "orders").select(k.alias("seq"), target.alias("_id"), F.lit(" New Name ").alias("name"), email.alias("email"), F.when(k % 11 == 0, "owner").otherwise("user").alias("role"))


_MAILBOXES = "with recursive " + A.USERS_SQL + ",\n" + _replayed(
    "select cast(_id as bigint) // 10 as g, cast(_id as bigint) as r, email as key from users",
    """select o_custkey // 10 as g, o_orderkey as seq, o_custkey as r, o_orderkey % 11 <> 0 as valid, o_orderkey % 9 <> 0 and u._id is not null as found,
  case o_orderkey % 4 when 0 then 'customer.' || lpad(cast(o_custkey // 10 * 10 + o_orderkey % 10 as varchar), 9, '0') || '@mail.test' when 1 then 'block.' || (o_custkey // 10) || '@mail.test'
    when 2 then 'customer.' || lpad(cast(o_custkey // 10 * 10 + (o_custkey + 1) % 10 as varchar), 9, '0') || '@mail.test' else 'own.' || o_custkey || '@mail.test' end as key
  from orders left join users u on u._id = cast(o_custkey as varchar)""",
)


@query(_MAILBOXES + " select u._id, case when a.r is null then u.name else 'New Name' end as name, coalesce(a.key, u.email) as email, case when a.r is null then u.role else 'user' end as role from users u left join applied a on a.r = cast(u._id as bigint)")
def replay_user_edits(spark: SparkSession, sf: str) -> DataFrame:
    return accounts.replay_user_edits(A.users(spark, sf), _mailbox_edits(spark, sf), A.as_of())[0].select("_id", "name", "email", "role")


@query(_MAILBOXES + " select seq, case when seq % 9 = 0 then 'none-' || r else cast(r as varchar) end as _id, status from judged where status <> 200")
def replay_user_edits_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return accounts.replay_user_edits(A.users(spark, sf), _mailbox_edits(spark, sf), A.as_of())[1].select("seq", "_id", "status")


def _user_deletes(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    target = F.when((c % 7 == 0) | (c % 2 == 1), F.concat(F.lit("x"), c.cast("string"))).otherwise(c.cast("string"))
    return A.table(spark, sf, "customer").select(F.when(c % 10 == 0, target).otherwise("admin").alias("actorId"), target.alias("targetId"))


@query(_USERS + "select * from users where cast(_id as bigint) % 2 = 1 or cast(_id as bigint) % 7 = 0 or cast(_id as bigint) % 10 = 0")
def delete_users(spark: SparkSession, sf: str) -> DataFrame:
    return accounts.delete_users(A.users(spark, sf), _user_deletes(spark, sf))[0]


@query(
    """with d as (select c_custkey as c, case when c_custkey % 7 = 0 or c_custkey % 2 = 1 then 'x' else '' end || c_custkey as t from customer where c_custkey % 7 = 0 or c_custkey % 2 = 1 or c_custkey % 10 = 0)
select case when c % 10 = 0 then t else 'admin' end as "actorId", t as "targetId", case when c % 10 = 0 then 400 else 404 end as status,
  case when c % 10 = 0 then 'You cannot delete the currently signed-in admin account.' else 'User not found.' end as message from d"""
)
def delete_users_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return accounts.delete_users(A.users(spark, sf), _user_deletes(spark, sf))[1]


@query(
    _with(A.USERS_SQL)
    + """, l as (select u._id, max(ts) as latest from events e join users u on cast(e.user_id as varchar) = u._id and ((event_type = 'view' and role = 'user') or (event_type = 'signup' and role = 'admin')) group by 1)
select u._id, greatest(u."lastLoginAt", l.latest) as "lastLoginAt" from users u left join l using (_id)"""
)
def fold_logins(spark: SparkSession, sf: str) -> DataFrame:
    u = A.users(spark, sf)
    portal = F.when(F.col("event_type") == "view", "user").when(F.col("event_type") == "signup", "admin")
    events = A.table(spark, sf, "events").join(u.select("_id", F.upper("email").alias("email")), F.col("_id") == F.col("user_id").cast("string")).select("email", portal.alias("portal"), "ts")
    return accounts.fold_logins(u, events).select("_id", "lastLoginAt")


# --- search, paging, export ------------------------------------------------------------------------------------------


@query(_USERS + "select * from users where contains(lower(name), '00001') or contains(lower(email), '00001') or contains(lower(role), '00001')")
def search_users(spark: SparkSession, sf: str) -> DataFrame:
    return browse.search_users(A.users(spark, sf), " 00001 ")


@query(_PRICES + "select * from (select * from prices " + _NEWEST + " limit 100) where contains(lower(\"companyName\"), 'click') or contains(lower(symbol), 'click') or contains(lower(notes), 'click')")
def search_prices(spark: SparkSession, sf: str) -> DataFrame:
    return browse.search_prices(A.prices(spark, sf), "CLICK")


@query(_PRICES + "select * from prices where contains(lower(\"companyName\"), '00012') or contains(lower(symbol), '00012') or contains(lower(notes), '00012')")
def search_prices_everywhere(spark: SparkSession, sf: str) -> DataFrame:
    return browse.search_prices(A.prices(spark, sf), "00012", scope=None)


@query(_PRICES + "select * from prices where contains(lower(\"companyName\"), '00012') or contains(lower(symbol), '00012') or contains(lower(notes), '00012')")
def search_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The search of the whole table by an index of trigrams."""
    path = f"{scratch(spark, 'trigrams')}/index"
    names = ("companyName", "symbol", "notes")
    search.write_index(A.prices(spark, sf), path, "_id", *names)
    return search.search_indexed(A.prices(spark, sf), path, "_id", " 00012", *names)


@query(_PRICES + "select * from prices " + _NEWEST + " limit 6 offset 594")
def stored_page(spark: SparkSession, sf: str) -> DataFrame:
    """Page 100 of the table, stored by ranges of its order."""
    path, order = scratch(spark, "pages"), [F.desc(c) for c in prices.NEWEST]
    layout.store_order(A.prices(spark, sf), order, path)
    return layout.stored_page(spark, path, order, 100, browse.RECORDS_PER_PAGE)[0]


@query(_USERS + 'select *, least(3, greatest(1, ceil((select count(*) from users) / 5.0)))::integer as page, (select count(*) from users)::integer as total from (select * from users order by "createdAt" desc, _id desc limit 5 offset 10)')
def paginate(spark: SparkSession, sf: str) -> DataFrame:
    rows, info = browse.paginate(A.users(spark, sf), [F.desc("createdAt"), F.desc("_id")], 3, browse.USERS_PER_PAGE)
    return rows.withColumns({"page": F.lit(info["page"]), "total": F.lit(info["total"])})


@query(_PRICES + "select row_number() over (" + _NEWEST + ") as n, _id from prices")
def numbered(spark: SparkSession, sf: str) -> DataFrame:
    return browse.numbered(A.prices(spark, sf).select(*prices.NEWEST), [F.desc(c) for c in prices.NEWEST]).select("n", "_id")


@query(_USERS + """select row_number() over (order by "createdAt" desc, _id desc) as n, name, email, role, coalesce(strftime("lastLoginAt", '%Y-%m-%d %H:%M:%S'), 'Not recorded') as last_login from users where contains(name, '1') or contains(email, '1') or contains(role, '1')""")
def export_users(spark: SparkSession, sf: str) -> DataFrame:
    return browse.export_users(A.users(spark, sf), "1")


@query(_USERS + """select '{"_id":"' || _id || '","name":"' || name || '","email":"' || email || '","role":"' || role || '"}' as json from users""")
def to_response(spark: SparkSession, sf: str) -> DataFrame:
    return browse.to_response(A.users(spark, sf).select("_id", "name", "email", "role"))


# --- reports and previews --------------------------------------------------------------------------------------------


@query(_with(A.REPORTS_SQL) + ', r as (select *, row_number() over (partition by "uploadedBy" order by "createdAt" desc, _id desc) as position from reports) select "uploadedBy", _id, "createdAt", position from r where position <= 8')
def recent_reports(spark: SparkSession, sf: str) -> DataFrame:
    return reports.recent_reports(A.reports(spark, sf)).select("uploadedBy", "_id", "createdAt", "position")


@query(_with(A.REQUESTS_SQL) + "select * from requests")
def parse_preview_request(spark: SparkSession, sf: str) -> DataFrame:
    return preview.parse_preview_request(A.preview_requests(spark, sf)).drop("json")


_PREVIEW = _with(A.PRICES_SQL, A.UNIVERSE_SQL, A.REPORTS_SQL, A.REQUESTS_SQL, A.RECENT_SQL)
_JOINED = """, q as (select q.*, s.symbol, s."companyName" as stock_name, s."recordCount", p._id as report_id, p."companyName" as report_name, p."originalFilename", p."processingStatus"
  from requests q left join universe s on s.symbol = q."selectedSymbol" left join picked p on p.request_id = q.request_id)"""


def _preview_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return preview.parse_preview_request(A.preview_requests(spark, sf)), prices.stock_universe(A.prices(spark, sf)), A.reports(spark, sf)


@query(_PREVIEW + _JOINED + ' select request_id, report_id, "originalFilename" from q')
def latest_report_for(spark: SparkSession, sf: str) -> DataFrame:
    requests = preview.parse_preview_request(A.preview_requests(spark, sf)).select("request_id", "userId", "reportId", "selectedSymbol")
    return reports.latest_report_for(requests, A.reports(spark, sf)).select("request_id", F.col("report._id").alias("report_id"), "report.originalFilename")


@query(
    _PREVIEW
    + _JOINED
    + """ select request_id, 0 as position, 'Stock data' as label, case when symbol is null then 'Waiting' else 'Ready' end as status from q
 union all select request_id, 1, 'Report intake', coalesce("processingStatus", 'Optional') from q
 union all select request_id, 2, 'Sentiment', case when "selectedSymbol" is null then 'Pending' else 'Prepared' end from q
 union all select request_id, 3, 'XAI insight', case when "selectedSymbol" is null then 'Waiting' else 'Preparing' end from q"""
)
def pipeline_status(spark: SparkSession, sf: str) -> DataFrame:
    return preview.pipeline_status(*_preview_parts(spark, sf))


_HAS = 'case when "selectedSymbol" is null then \'{1}\' else \'{0}\' end'


def _module(code: str, title: str, status: str, tone: str, output: str, given: str, evidence: str) -> str:
    return f"select request_id, '{code}' as code, '{title}' as title, {status} as status, {tone} as tone, {output} as output, {given} as input, {evidence} as evidence from q"


@query(
    _PREVIEW
    + _JOINED
    + "\nunion all ".join(
        [
            " " + _module("01", "Stock Data Component", "case when symbol is null then 'Waiting' else 'Available' end", "case when symbol is null then 'pending' else 'ready' end", "coalesce(symbol, 'No stock selected')", "coalesce(stock_name, 'Company selection required')", """coalesce("recordCount" || ' market records checked.', 'Return to controls and select a company.')"""),
            _module("02", "Financial Report Component", "coalesce(\"processingStatus\", 'Optional')", "case when report_id is null then 'pending' else 'queued' end", "coalesce(\"originalFilename\", 'No report uploaded')", "coalesce(report_name, stock_name, 'PDF report optional')", "case when report_id is null then 'Preview generated without a financial report.' else 'Report is queued for document parsing.' end"),
            _module("03", "Sentiment Component", _HAS.format("Prepared", "Pending"), _HAS.format("ready", "pending"), _HAS.format("Market sentiment signal prepared", "Not generated"), "coalesce(stock_name, 'Company selection required')", _HAS.format("Market context prepared as a separate signal.", "Generate preview to prepare this output.")),
            _module("04", "Risk Component", _HAS.format("Calculated", "Pending"), _HAS.format("ready", "pending"), _HAS.format("Moderate risk level", "Not generated"), "coalesce(symbol, 'Stock data required')", _HAS.format("Uncertainty is separated from the final insight.", "Risk output appears after setup.")),
            _module("05", "Explainable AI Component", _HAS.format("Prepared", "Waiting"), _HAS.format("ready", "pending"), _HAS.format("Top contributing factors identified", "Not generated"), "'Stock, report, sentiment, and risk outputs'", _HAS.format("Key factors are ready for explanation.", "XAI output appears after preview generation.")),
        ]
    )
)
def component_outputs(spark: SparkSession, sf: str) -> DataFrame:
    return preview.component_outputs(*_preview_parts(spark, sf))


# --- request rates ---------------------------------------------------------------------------------------------------


@query("""select cast(user_id as varchar) as client, time_bucket(interval '15 minutes', ts) as start, count(*) as requests from events group by 1, 2 having count(*) > 1""")
def request_rate_audit(spark: SparkSession, sf: str) -> DataFrame:
    log = A.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("client"), "ts")
    found = jobs.request_rate_audit(log, limit=1)
    return found.select("client", scalars.utc_wall_time(F.col("start")).alias("start"), "requests")


@query(
    """with recursive w as (select user_id, min(ts) as start from events group by 1 union all
  select w.user_id, (select min(e.ts) from events e where e.user_id = w.user_id and e.ts >= w.start + interval 6 hours) from w where w.start is not null),
s as (select user_id, start, lead(start) over (partition by user_id order by start) as following from w where start is not null)
select cast(s.user_id as varchar) as client, s.start, count(*) as requests from s join events e on e.user_id = s.user_id and e.ts >= s.start and (following is null or e.ts < following)
group by 1, 2 having count(*) > 1"""
)
def limiter_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of six hours, since the clients of ``events`` seldom ask; each begins at a request."""
    log = A.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("client"), "ts")
    done = jobs.limiter_audit(log, limit=1, minutes=360)
    return done.withColumn("start", F.col("start").cast("timestamp_ntz"))
