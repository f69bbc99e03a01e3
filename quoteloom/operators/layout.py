"""Tables written so that a reader opens few files: prices by year and symbol, and any order by ranges."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..schemas import PRICES
from .browse import page_info


def write_prices(prices: DataFrame, path: str, parts: int | None = None) -> None:
    """By year of trade, and inside a year in files that each hold a range of symbols; ``path`` must be new, never one that is being read.

    ``_ranges`` beside the years lists the files with their first and last symbol: a row a file.  A symbol with more rows than a file
    goes on, by date, in the next ones."""
    parts = parts or int(prices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["trade_year", "symbol", "tradeDate"]
    dealt = prices.withColumn("trade_year", F.year("tradeDate")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt.write.partitionBy("trade_year").parquet(path)
    written = prices.sparkSession.read.schema(StructType([*PRICES.fields, StructField("trade_year", IntegerType())])).parquet(path)
    files = written.groupBy(F.col("_metadata.file_path").alias("file"), "trade_year")  # one column of the table is read for this
    files.agg(F.min("symbol").alias("first"), F.max("symbol").alias("last"), F.count("*").alias("rows")).write.parquet(f"{path}/_ranges")


def read_symbol(spark: SparkSession, path: str, symbol: str, years: list[int] | None = None) -> DataFrame:
    """Rows of one symbol, in upper case, of all years or some, from a table of ``write_prices``; files that cannot hold it are not opened."""
    wanted = symbol.upper()
    files = spark.read.parquet(f"{path}/_ranges").where((F.col("first") <= wanted) & (F.col("last") >= wanted))
    if years is not None:
        files = files.where(F.col("trade_year").isin(years))
    paths = [r.file for r in files.select("file").collect()]  # the files of one symbol
    rows = spark.read.schema(PRICES).parquet(*paths) if paths else spark.createDataFrame([], PRICES)
    return rows.where(F.col("symbol") == wanted)


def store_order(df: DataFrame, order: list[Column], path: str, parts: int | None = None) -> None:
    """Writes ``df`` by ranges of a total order, and beside them how many rows stand before each: a row a range."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()).sortWithinPartitions("_range", *order)
    dealt.write.partitionBy("_range").parquet(f"{path}/rows")
    df.limit(0).coalesce(1).write.parquet(f"{path}/columns")
    counts = df.sparkSession.read.schema(StructType([*df.schema.fields, StructField("_range", IntegerType())])).parquet(f"{path}/rows").groupBy("_range").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts.select("_range", "rows", before.alias("before")).coalesce(1).write.parquet(f"{path}/counts")


def stored_page(spark: SparkSession, path: str, order: list[Column], page: int, size: int) -> tuple[DataFrame, dict[str, int]]:
    """(rows of the page, info) of an order written by ``store_order``: the ranges that the page stands in are read, of which there are
    one or two for pages below a range's size; the page is moved into the range that exists."""
    counts = spark.read.schema("_range int, rows long, before long").parquet(f"{path}/counts")
    total = counts.agg(F.sum("rows")).first()[0] or 0
    info = page_info(total, page, size)
    start = (info["page"] - 1) * size
    held = counts.where((F.col("before") < start + size) & (F.col("before") + F.col("rows") > start)).orderBy("before").collect()  # ranges of one page
    columns = spark.read.parquet(f"{path}/columns").schema
    rows = spark.read.schema(StructType([*columns.fields, StructField("_range", IntegerType())])).parquet(f"{path}/rows").where(F.col("_range").isin([r["_range"] for r in held])).drop("_range")
    first = held[0].before if held else 0
    return rows.orderBy(*order).offset(start - first).limit(size), info
