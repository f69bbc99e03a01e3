"""The stock universe kept up to date: a small state for each symbol takes inserts, edits and deletes, without the table."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prices import NEWEST

#: Newest rows that a symbol's state keeps.
KEEP = 4
_ROW = [*NEWEST, "companyName", "close", "volume"]


def _row():
    return F.struct(*_ROW)


def _top(rows: DataFrame) -> DataFrame:
    """The newest KEEP + 1 of each symbol; the rank filter is applied before the shuffle too, so no symbol is too large."""
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(*(F.desc(c) for c in NEWEST)))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= KEEP + 1).drop("_rank")


def _listed(rows: DataFrame) -> DataFrame:
    """(symbol, newest): up to KEEP + 1 rows of each symbol, newest first."""
    return rows.groupBy("symbol").agg(F.reverse(F.array_sort(F.collect_list("r"))).alias("newest"))


def _state(symbol, count, newest, edge):
    """newest has one row more than is kept where there are more: that one says where the known rows end."""
    more = F.size(newest) > KEEP
    kept = F.slice(newest, 1, KEEP)
    return [symbol, count.alias("recordCount"), kept.alias("newest"), F.when(more, F.element_at(kept, -1)).otherwise(edge).alias("edge")]


def universe_state(prices: DataFrame) -> DataFrame:
    """(symbol, recordCount, newest, edge): the newest rows, and the last of them if the table has older ones (all rows from ``edge``
    on are in ``newest``; none: all rows are)."""
    listed = _listed(_top(prices.select("symbol", *_ROW)).select("symbol", _row().alias("r")))
    counts = prices.groupBy(F.col("symbol").alias("s")).agg(F.count("*").alias("n"))
    both = listed.join(counts, F.col("symbol").eqNullSafe(F.col("s")))
    return both.select(*_state(F.col("symbol"), F.col("n"), F.col("newest"), F.lit(None)))


def update_universe(state: DataFrame, changes: DataFrame, table: DataFrame) -> DataFrame:
    """The state after ``changes``: (kind, and the columns of prices), kind ``insert`` or ``delete``; an edit is a delete of the old row and an
    insert of the new one.  A row may change several times: what is inserted and deleted again cancels out, in any order.  ``table`` is
    read for those symbols alone whose known rows have all gone.

    A new row that is older than ``edge`` only counts, since unknown ones may stand between."""
    sign = F.when(F.col("kind") == "insert", 1).otherwise(-1)
    known = changes.where("symbol is not null").groupBy("symbol", *_ROW).agg(F.sum(sign).alias("net")).where("net <> 0")
    counts = known.groupBy("symbol").agg(F.sum("net").alias("change"))
    gone = known.where("net < 0").select("_id").distinct()
    # of a symbol's deletes only those of kept rows matter, KEEP at most
    old = state.select("symbol", F.explode("newest").alias("r")).withColumn("_id", F.col("r._id"))
    left = old.join(gone, "_id", "left_anti").select("symbol", "r")
    new = _top(known.where("net > 0").select("symbol", *_ROW)).select("symbol", _row().alias("r"))
    edges = state.select("symbol", "edge")
    new = new.join(edges, "symbol", "left").where(F.col("edge").isNull() | (F.col("r") > F.col("edge"))).select("symbol", "r")
    listed = _listed(left.unionByName(new))
    after = state.select("symbol", "recordCount", "edge").join(counts, "symbol", "full_outer").join(listed, "symbol", "left")
    count = F.coalesce("recordCount", F.lit(0)) + F.coalesce("change", F.lit(0))
    after = after.select(*_state(F.col("symbol"), count, F.coalesce("newest", F.array().cast(state.schema["newest"].dataType)), F.col("edge"))).where("recordCount > 0")
    empty = F.size("newest") == 0
    refilled = universe_state(table.join(after.where(empty).select("symbol"), "symbol", "left_semi"))
    return after.where(~empty).unionByName(refilled)


def universe_of(state: DataFrame) -> DataFrame:
    """The rows of ``stock_universe``."""
    n = F.col("newest")[0]
    return state.select("symbol", n["companyName"].alias("companyName"), n["close"].alias("latestClose"), n["volume"].alias("latestVolume"), n["tradeDate"].alias("latestTradeDate"), "recordCount")
