"""Search, paging, numbering and JSON answers over any table."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import save
from .prices import list_prices

USERS_PER_PAGE, RECORDS_PER_PAGE = 5, 6
#: Pages that end within so many rows are the first rows of the order; deeper ones are taken by number.
NEAR = 10_000


def containing(df: DataFrame, query: str | None, *names: str) -> DataFrame:
    """Rows one of whose columns holds the trimmed query, letter case aside and literally; blank: all rows."""
    text = (query or "").strip().lower()
    if not text:
        return df
    hits = [F.coalesce(F.lower(F.col(n)).contains(text), F.lit(False)) for n in names]
    return df.where(hits[0] if len(hits) == 1 else F.array_contains(F.array(*hits), True))


def search_users(users: DataFrame, query: str | None) -> DataFrame:
    return containing(users, query, "name", "email", "role")


def search_prices(prices: DataFrame, query: str | None, scope: int | None = 100) -> DataFrame:
    """Among the newest ``scope`` rows; None searches the whole table."""
    return containing(prices if scope is None else list_prices(prices, n=scope), query, "companyName", "symbol", "notes")


def page_info(total: int, page: int, size: int) -> dict[str, int]:
    pages = max(1, math.ceil(total / size))
    at = min(max(1, page), pages)
    return {"page": at, "totalPages": pages, "total": total, "shown": max(0, min(size, total - (at - 1) * size))}


def paginate(df: DataFrame, order: list[Column], page: int, size: int) -> tuple[DataFrame, dict[str, int]]:
    """(rows of the page, info); the page is moved into the range that exists.  ``order`` must be total.

    A page far down is found by the numbers of ranges of the order, so that no task carries all rows before it."""
    info = page_info(df.count(), page, size)
    start = (info["page"] - 1) * size
    if start + size <= NEAR:
        return df.orderBy(*order).offset(start).limit(size), info
    (name,) = _fresh(df, "number")
    rows = numbered(df, order, name).where(F.col(name).between(start + 1, start + size))
    return rows.orderBy(name).drop(name), info


def _fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front until ``df`` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def numbered(df: DataFrame, order: list[Column], name: str = "n", parts: int | None = None) -> DataFrame:
    """Rows with their number in the order, from 1, without a window over the whole table.

    The rows are dealt by ranges of the order; a part's numbers start after the counts of the parts before it, of which
    there is one row a part.  ``order`` must be total, so that a rerun deals rows alike."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, row, start = _fresh(df, "part", "row", "start")
    # written, since ranges are drawn from a sample and a second reading might draw others
    dealt = save(df.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()), "numbered")
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(part).agg(F.count("*").alias(row)).select(part, F.coalesce(F.sum(row).over(before), F.lit(0)).alias(start))
    number = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    rows = dealt.withColumn(row, number).join(F.broadcast(starts), part)  # one row a part
    return rows.withColumn(name, F.col(start) + F.col(row)).drop(part, row, start)


def export_users(users: DataFrame, query: str | None = None) -> DataFrame:
    """Numbered rows of the users that match, newest first."""
    rows = numbered(search_users(users, query), [F.desc("createdAt"), F.desc("_id")])
    seen = F.coalesce(F.date_format("lastLoginAt", "yyyy-MM-dd HH:mm:ss"), F.lit("Not recorded"))
    return rows.select("n", "name", "email", "role", seen.alias("last_login"))


def to_response(df: DataFrame) -> DataFrame:
    """One JSON document a row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
