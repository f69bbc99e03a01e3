"""The three tables and their batches, derived from the driver's tables, on both sides: as DataFrames for Spark, as
common table expressions for the SQL that checks it.  For tests and queries only."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import PRICES, REPORTS, USERS

AS_OF = "2030-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def text(col: str):
    return F.col(col).cast("string")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, c = table(spark, sf_dir, "events"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    made = {
        "_id": text("event_id"),
        "symbol": F.concat(F.lit("U"), text("user_id")),
        "companyName": F.col("c_name"),
        "tradeDate": F.col("ts"),
        **dict.fromkeys(["open", "high", "low", "close"], F.col("value")),
        "adjustedClose": F.when(F.col("event_type") != "error", F.col("value")),
        "volume": F.regexp_extract("props", r'"k": (\d+)', 1).cast("double"),
        "source": F.lit("events"),
        "notes": F.col("event_type"),
        "createdBy": text("user_id"),
        "createdAt": F.col("ts"),
        "updatedAt": F.col("ts"),
    }
    return e.join(c, F.col("c_custkey") == F.col("user_id")).select(*(made[n].alias(n) for n in PRICES.names))


PRICES_SQL = """prices as (select cast(event_id as varchar) as _id, 'U' || user_id as symbol, c_name as "companyName", ts as "tradeDate",
  value as open, value as high, value as low, value as close, case when event_type <> 'error' then value end as "adjustedClose",
  cast(regexp_extract(props, '"k": ([0-9]+)', 1) as double) as volume, 'events' as source, event_type as notes,
  cast(user_id as varchar) as "createdBy", ts as "createdAt", ts as "updatedAt" from events join customer on c_custkey = user_id)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("lastLoginAt"))
    c = table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    created = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, c_custkey)")
    made = {
        "_id": text("c_custkey"),
        "name": F.col("c_name"),
        "email": F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@mail.test")),
        "role": F.when(F.col("c_mktsegment") == "MACHINERY", "admin").otherwise("user"),
        "lastLoginAt": F.col("lastLoginAt"),
        "createdAt": created,
        "updatedAt": created,
    }
    return c.select(*(made[n].alias(n) for n in USERS.names))


USERS_SQL = """users as (select cast(c_custkey as varchar) as _id, c_name as name, lower(replace(c_name, '#', '.')) || '@mail.test' as email,
  case when c_mktsegment = 'MACHINERY' then 'admin' else 'user' end as role, l.d as "lastLoginAt",
  timestamp '2024-01-01' + to_seconds(c_custkey) as "createdAt", timestamp '2024-01-01' + to_seconds(c_custkey) as "updatedAt"
  from customer left join (select o_custkey, max(o_orderdate) as d from orders group by 1) l on o_custkey = c_custkey)"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = text("o_orderkey")
    n = (F.col("o_orderkey") % 20).cast("string")
    made = {
        "_id": key,
        "stockSymbol": F.concat(F.lit("U"), n),
        "companyName": F.concat(F.lit("Company "), n),
        "originalFilename": F.concat(F.lit("report-"), key, F.lit(".pdf")),
        "storedFilename": F.concat(F.lit("0-report-"), key, F.lit(".pdf")),
        "mimeType": F.lit("application/pdf"),
        "sizeBytes": F.floor("o_totalprice").cast("long"),
        "storagePath": F.concat(F.lit("/reports/"), key),
        "processingStatus": F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "processed").otherwise("uploaded"),
        "summary": F.lit(""),
        "uploadedBy": text("o_custkey"),
        "createdAt": F.col("o_orderdate"),
        "updatedAt": F.col("o_orderdate"),
    }
    return table(spark, sf_dir, "orders").select(*(made[c].alias(c) for c in REPORTS.names))


REPORTS_SQL = """reports as (select cast(o_orderkey as varchar) as _id, 'U' || (o_orderkey % 20) as "stockSymbol", 'Company ' || (o_orderkey % 20) as "companyName",
  'report-' || o_orderkey || '.pdf' as "originalFilename", 'application/pdf' as "mimeType", cast(floor(o_totalprice) as bigint) as "sizeBytes",
  case o_orderstatus when 'O' then 'queued' when 'F' then 'processed' else 'uploaded' end as "processingStatus", '' as summary,
  cast(o_custkey as varchar) as "uploadedBy", o_orderdate as "createdAt" from orders)"""


def price_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(existing, incoming): three uploads that overlap the table, with later rows for some of their keys."""
    p = prices(spark, sf_dir).withColumn("n", F.col("_id").cast("long"))
    new = p.where("n % 10 >= 5").withColumns({"upload_seq": F.col("n") % 3, "upload_id": (F.col("n") % 3).cast("string"), "row_idx": F.col("n")})
    first = new.withColumn("close", F.col("close") + 1)
    again = new.where("n % 7 = 0").withColumns({"close": F.col("close") + 2, "adjustedClose": F.lit(None).cast("double"), "notes": F.lit(""), "row_idx": F.col("n") + 10**12})
    return p.where("n % 10 < 7").drop("n"), first.unionByName(again).drop("n", "_id", "createdAt", "updatedAt")


BATCH_SQL = (
    PRICES_SQL
    + """, existing as (select * from prices where cast(_id as bigint) % 10 < 7),
incoming as (select symbol, "tradeDate", "companyName", open, high, low, close + 1 as close, "adjustedClose", volume, notes, source, "createdBy",
   cast(_id as bigint) % 3 as upload_seq, cast(cast(_id as bigint) % 3 as varchar) as upload_id, cast(_id as bigint) as row_idx from prices where cast(_id as bigint) % 10 >= 5
  union all select symbol, "tradeDate", "companyName", open, high, low, close + 2, null, volume, '', source, "createdBy",
   cast(_id as bigint) % 3, cast(cast(_id as bigint) % 3 as varchar), cast(_id as bigint) + 1000000000000 from prices where cast(_id as bigint) % 10 >= 5 and cast(_id as bigint) % 7 = 0)"""
)


def raw_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as a CSV holds them: thousands commas, blanks, and some that are no number or date."""
    odd = F.col("l_partkey") % 50
    price = F.when(odd == 1, "12x").when(odd == 2, "0x1F").when(odd == 3, "1e3").when(odd == 4, ",").when(F.col("l_linenumber") == 7, "").otherwise(F.format_number("l_extendedprice", 2))
    day = F.when(odd == 5, "soon").when(odd == 6, F.date_format("l_shipdate", "M/d/yyyy")).when(odd == 7, F.date_format("l_shipdate", "yyyy/M/d")).when(odd == 8, "").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    plain = F.when(odd == 9, "-1").when(odd == 10, "1d").when(odd == 11, "").otherwise(text("l_quantity"))
    named = F.when(odd == 12, "x").otherwise(F.concat(F.lit(" s"), text("l_suppkey"), F.lit(" ")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", price.alias("price"), day.alias("day"), plain.alias("plain"), named.alias("named"))


RAW_SQL = """raw as (select l_orderkey, l_partkey, l_suppkey, l_linenumber,
  case l_partkey % 50 when 1 then '12x' when 2 then '0x1F' when 3 then '1e3' when 4 then ',' else case when l_linenumber = 7 then '' else format('{:,.2f}', l_extendedprice) end end as price,
  case l_partkey % 50 when 5 then 'soon' when 6 then strftime(l_shipdate, '%-m/%-d/%Y') when 7 then strftime(l_shipdate, '%Y/%-m/%-d') when 8 then '' else strftime(l_shipdate, '%Y-%m-%d') end as day,
  case l_partkey % 50 when 9 then '-1' when 10 then '1d' when 11 then '' else cast(l_quantity as varchar) end as plain,
  case l_partkey % 50 when 12 then 'x' else ' s' || l_suppkey || ' ' end as named, l_shipdate, l_extendedprice from lineitem),
parsed as (select *, case when price in (',', '') or price = '12x' then null when price = '0x1F' then 31.0 else cast(replace(price, ',', '') as double) end as number,
  price = '12x' as bad_number, case when day in ('soon', '') then null else date_trunc('day', l_shipdate) end as trade_day from raw)"""


def preview_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, userId, json): some without report, some broken, some empty."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    report = F.when(k % 3 == 0, F.concat(F.lit('"'), k.cast("string"), F.lit('"'))).otherwise("null")
    json = F.concat(F.lit('{"generatedAt": "now", "reportId": '), report, F.lit(', "selectedSymbol": "U'), (k % 25).cast("string"), F.lit('"}'))
    json = F.when(k % 11 == 0, "{broken").when(k % 13 == 0, "{}").otherwise(json)
    return o.select(k.cast("string").alias("request_id"), text("o_custkey").alias("userId"), json.alias("json"))


REQUESTS_SQL = """requests as (select cast(o_orderkey as varchar) as request_id, cast(o_custkey as varchar) as "userId",
  case when o_orderkey % 11 = 0 or o_orderkey % 13 = 0 then null else 'now' end as "generatedAt",
  case when o_orderkey % 11 = 0 or o_orderkey % 13 = 0 or o_orderkey % 3 <> 0 then null else cast(o_orderkey as varchar) end as "reportId",
  case when o_orderkey % 11 = 0 or o_orderkey % 13 = 0 then null else 'U' || (o_orderkey % 25) end as "selectedSymbol" from orders)"""

UNIVERSE_SQL = """universe as (select symbol, "companyName", close as "latestClose", volume as "latestVolume", "tradeDate" as "latestTradeDate", n as "recordCount"
  from (select *, row_number() over (partition by symbol order by "tradeDate" desc, "createdAt" desc, _id desc) as rn, count(*) over (partition by symbol) as n from prices) where rn = 1)"""

RECENT_SQL = """recent as (select * from (select *, row_number() over (partition by "uploadedBy" order by "createdAt" desc, _id desc) as position from reports) where position <= 8),
picked as (select * from (select q.request_id, r.*, row_number() over (partition by q.request_id order by r._id = coalesce(q."reportId", '') desc, r."createdAt" desc, r._id desc) as rn
  from requests q join recent r on r."uploadedBy" = q."userId" and (r._id = q."reportId" or r."stockSymbol" = q."selectedSymbol")) where rn = 1)"""
