"""Search of a whole table by an index of trigrams: rows that hold all trigrams of the query are looked up, and then verified."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .browse import containing

#: Folders that postings are dealt into, by trigram.
FOLDERS = 64
#: Trigrams of a query that are looked up: the rarest ones.
RAREST = 3


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a text in lower case; none for shorter ones."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def folder_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def write_index(df: DataFrame, path: str, key: str, *names: str) -> None:
    """Postings (gram, field, key), a row each, and how many each trigram has; by folders of trigrams, sorted, so that a reader opens
    one folder for a trigram and skips what is not its own.  A common trigram is rows like any, never one list."""

    def postings(name: str, number: int) -> Column:
        return F.transform(trigrams(F.col(name)), lambda g: F.struct(g.alias("gram"), F.lit(number).alias("field")))

    fields = [postings(name, i) for i, name in enumerate(names)]
    rows = df.select(F.col(key).cast("string").alias("key"), F.explode(F.concat(*fields)).alias("p")).select("key", "p.gram", "p.field")
    rows = rows.withColumn("folder", folder_of(F.col("gram")))
    dealt = rows.repartitionByRange("folder", "gram", "key").sortWithinPartitions("folder", "gram", "key")
    dealt.write.partitionBy("folder").parquet(f"{path}/postings")
    counts = df.sparkSession.read.schema("key string, gram string, field int, folder int").parquet(f"{path}/postings").groupBy("gram", "folder").agg(F.count("*").alias("n"))
    counts.repartitionByRange("folder", "gram").sortWithinPartitions("gram").write.partitionBy("folder").parquet(f"{path}/counts")


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(key) of rows a field of which holds the query's rarest trigrams; the query must have three characters."""
    text = spark.range(1).select(trigrams(F.lit(query)).alias("g"))
    grams = text.select(F.explode("g").alias("gram")).select("gram", folder_of(F.col("gram")).alias("folder")).collect()  # those of the query
    folders = sorted({r.folder for r in grams})
    here = F.col("folder").isin(folders) & F.col("gram").isin([r.gram for r in grams])
    counts = spark.read.schema("gram string, n long, folder int").parquet(f"{path}/counts").where(here)
    known = {r.gram: r.n for r in counts.collect()}
    rarest = sorted(grams, key=lambda r: (known.get(r.gram, 0), r.gram))[:RAREST]
    if any(r.gram not in known for r in rarest):  # a trigram that no row has
        rarest = rarest[:1]
    postings = spark.read.schema("key string, gram string, field int, folder int").parquet(f"{path}/postings")
    wanted = postings.where(F.col("folder").isin(sorted({r.folder for r in rarest})) & F.col("gram").isin([r.gram for r in rarest]))
    found = wanted.groupBy("key", "field").agg(F.count("*").alias("held")).where(F.col("held") == len(rarest))
    return found.select("key").distinct()


def search_indexed(df: DataFrame, path: str, key: str, query: str | None, *names: str) -> DataFrame:
    """The rows that ``containing`` finds, by the index over the same columns; queries of less than three characters read the table."""
    text = (query or "").strip().lower()
    if len(text) < 3:
        return containing(df, query, *names)
    found = candidates(df.sparkSession, path, text).withColumnRenamed("key", "_found")
    rows = df.join(found, F.col(key).cast("string") == F.col("_found"), "left_semi")
    return containing(rows, query, *names)
