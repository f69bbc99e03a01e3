"""The price table: newest rows, the universe of symbols, and the merges that keep (symbol, tradeDate) unique."""

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import normalize_symbol, number_text, parse_trade_date, trimmed, utc_wall_time
from ..functions.validation import INVALID_INPUT, validate_prices
from ..schemas import IMPORTED, PRICES
from ..storage import save
from .chains import settle

KEY = ["symbol", "tradeDate"]
NEWEST = ["tradeDate", "createdAt", "_id"]
NOT_FOUND = "Stock record not found."
#: Logarithm of the registers of a sketch.
PRECISION = 14
TAKEN = "A record with this unique value already exists."


def _desc(*names: str) -> list[Column]:
    return [F.desc(n) for n in names]


def stock_universe(prices: DataFrame) -> DataFrame:
    """Per symbol the values of its newest row, and how many rows it has.

    max_by keeps one row a symbol and task before the shuffle, so a long-listed symbol is no hot key; a newest value
    that is null stays null."""
    newest = F.max_by(F.struct("companyName", "close", "volume", "tradeDate"), F.struct(*NEWEST))
    rows = prices.groupBy("symbol").agg(newest.alias("n"), F.count("*").alias("recordCount"))
    named = rows.select("symbol", F.col("n.companyName").alias("companyName"), F.col("n.close").alias("latestClose"), F.col("n.volume").alias("latestVolume"), F.col("n.tradeDate").alias("latestTradeDate"), "recordCount")
    return named.orderBy("companyName", "symbol")


def latest_price_per_symbol(prices: DataFrame) -> DataFrame:
    """The whole newest row of each symbol."""
    return prices.groupBy("symbol").agg(F.max_by(F.struct(*prices.columns), F.struct(*NEWEST)).alias("n")).select("n.*")


def filter_symbol(prices: DataFrame, symbol: str | None = None) -> DataFrame:
    """Rows of the symbol, in upper case but not trimmed; none given: all rows."""
    return prices.where(F.col("symbol") == symbol.upper()) if symbol else prices


def list_prices(prices: DataFrame, symbol: str | None = None, n: int = 100) -> DataFrame:
    return filter_symbol(prices, symbol).orderBy(*_desc(*NEWEST)).limit(n)


def latest_prices(prices: DataFrame, n: int = 8) -> DataFrame:
    return list_prices(prices, n=n)


def admin_overview(users: DataFrame, prices: DataFrame) -> DataFrame:
    """One row of counts; companies are counted by symbol."""
    people = users.agg(F.count_if(F.col("role") == "user").alias("userCount"), F.count_if(F.col("role") == "admin").alias("adminCount"))
    rows = prices.agg(F.count("*").alias("stockRecordCount"), F.count_distinct("symbol").alias("companyCount"))
    return people.crossJoin(rows)  # one row each


def company_sketches(prices: DataFrame, precision: int = PRECISION) -> DataFrame:
    """(trade_year, rows, companies): for each year the rows and a HyperLogLog sketch of its symbols, to be stored."""
    return prices.groupBy(F.year("tradeDate").alias("trade_year")).agg(F.count("*").alias("rows"), F.hll_sketch_agg("symbol", precision).alias("companies"))


def approximate_overview(users: DataFrame, sketches: DataFrame) -> DataFrame:
    """``admin_overview`` from the sketches of years, which are merged; no price is read.

    companyCount is off by more than 3 * 1.04 / sqrt(2 ** precision) of itself in one of several hundred cases: 2.4 % at 14."""
    people = users.agg(F.count_if(F.col("role") == "user").alias("userCount"), F.count_if(F.col("role") == "admin").alias("adminCount"))
    rows = sketches.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("stockRecordCount"), F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("companies")), F.lit(0)).alias("companyCount"))
    return people.crossJoin(rows)  # one row each


def price_edit_view(prices: DataFrame) -> DataFrame:
    """What the edit form shows."""
    day = F.date_format("tradeDate", "yyyy-MM-dd").alias("tradeDate")
    values = [F.col(c) for c in ("open", "high", "low", "close")]
    return prices.select("_id", "symbol", "companyName", day, *values, F.coalesce(number_text(F.col("adjustedClose")), F.lit("")).alias("adjustedClose"), "volume", F.coalesce("notes", F.lit("")).alias("notes"))


def price_display(prices: DataFrame) -> DataFrame:
    """What the table of records shows."""
    parts = [F.concat(F.lit(f"{said}: "), F.coalesce(number_text(F.col(c)), F.lit(""))) for said, c in (("O", "open"), ("H", "high"), ("L", "low"), ("C", "close"))]
    return prices.select("_id", "companyName", "symbol", F.date_format("tradeDate", "yyyy-MM-dd").alias("date"), F.concat_ws(" | ", *parts).alias("prices"), number_text(F.col("volume")).alias("volume"))


def dedupe_batch(df: DataFrame, keys: list[str], order: list[str], keep: str = "last") -> DataFrame:
    """One row a key: the first or last by ``order``."""
    pick = {"last": F.max_by, "first": F.min_by}[keep]
    return df.groupBy(*keys).agg(pick(F.struct(*df.columns), F.struct(*order)).alias("w")).select("w.*")


def new_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), 1, 24)


def upsert_prices(existing: DataFrame, incoming: DataFrame, as_of: Column) -> DataFrame:
    """Update or insert by (symbol, tradeDate); of rows for one key in the batch the last counts.

    A match takes all imported values, nulls too, and keeps its _id and createdAt; so a flag tells matches, not a null
    test.  Both sides are dealt by the full key: a symbol alone would be a hot key."""
    batch = dedupe_batch(incoming, KEY, ["upload_seq", "row_idx"]).select(*KEY, *(F.col(c).alias(f"new_{c}") for c in IMPORTED), F.lit(True).alias("new"))
    both = existing.withColumn("old", F.lit(True)).join(batch, KEY, "full_outer")
    new = F.coalesce("new", F.lit(False))
    columns = {c: F.when(new, F.col(f"new_{c}")).otherwise(F.col(c)) for c in IMPORTED}
    columns["_id"] = F.when(F.col("old"), F.col("_id")).otherwise(new_id(*map(F.col, KEY)))
    columns["createdAt"] = F.when(F.col("old"), F.col("createdAt")).otherwise(as_of)
    columns["updatedAt"] = F.when(new, as_of).otherwise(F.col("updatedAt"))
    return both.select(*(columns.get(c, F.col(c)).alias(c) for c in PRICES.names))


def import_summary(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Per upload: rows that were new to the table (upserted), and all others (matched, and so modified)."""
    known = existing.select(*KEY, F.lit(True).alias("known"))
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy("upload_seq", "row_idx")) == 1
    rows = incoming.withColumn("first", first).join(known, KEY, "left")
    added = F.col("first") & F.col("known").isNull()
    sums = rows.groupBy("upload_id").agg(F.count_if(~added).alias("matched"), F.count_if(added).alias("upserted"), F.count("*").alias("totalRows"))
    return sums.select("upload_id", "matched", F.col("matched").alias("modified"), "upserted", "totalRows")


def among(good: str, seq: str, *keys: str) -> WindowSpec:
    """A window by ``keys`` over the good rows; all others, whose keys may be null or alike, are dealt by their number."""
    return Window.partitionBy(good, *(F.when(F.col(good), F.col(k)) for k in keys), F.when(~F.col(good), F.col(seq)))


def judge_price_edits(prices: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits with status (200, 400, 404 or 409) and message, against the table as it is before the batch.

    edits: edit_seq, _id and raw strings.  Of good edits of one row the last counts; of edits that land on one key the
    first row to do so does."""
    checked = validate_prices(edits).withColumns({"newSymbol": normalize_symbol(F.col("symbol")), "newDate": utc_wall_time(parse_trade_date(F.col("tradeDate")))})
    found = checked.join(prices.select("_id", F.lit(True).alias("found")), "_id", "left")
    owner = prices.select(F.col("symbol").alias("newSymbol"), F.col("tradeDate").alias("newDate"), F.col("_id").alias("owner"))
    owned = found.join(owner, ["newSymbol", "newDate"], "left")
    valid = F.size("errors") == 0
    good = valid & F.col("found") & (F.col("owner").isNull() | (F.col("owner") == F.col("_id")))
    owned = owned.withColumn("good", F.coalesce(good, F.lit(False)))
    last = F.max(F.when(F.col("good"), F.col("edit_seq"))).over(among("good", "edit_seq", "_id"))
    first = F.min(F.when(F.col("good"), F.struct("edit_seq", "_id"))).over(among("good", "edit_seq", "newSymbol", "newDate"))
    owned = owned.withColumns({"applied": F.col("good") & (F.col("edit_seq") == last), "second": F.col("good") & (first["_id"] != F.col("_id"))})
    status = F.when(~valid, 400).when(F.col("found").isNull(), 404).when(~F.col("good") | F.col("second"), 409).otherwise(200)
    said = F.when(status == 400, INVALID_INPUT).when(status == 404, NOT_FOUND).when(status == 409, TAKEN)
    return owned.withColumns({"status": status, "message": said, "applied": F.col("applied") & ~F.col("second")})


def _edited(prices: DataFrame, judged: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(prices, rejects) of judged edits, of which one a row has ``applied``."""
    number = {c: F.nullif(F.col(c).cast("string"), F.lit("")).try_cast("double") for c in ("open", "high", "low", "close", "adjustedClose", "volume")}
    values = {"symbol": F.col("newSymbol"), "companyName": trimmed(F.col("companyName")), "tradeDate": F.col("newDate"), **number, "notes": trimmed(F.coalesce("notes", F.lit("")))}
    applied = judged.where("applied").select("_id", *(v.alias(f"new_{c}") for c, v in values.items()), F.lit(True).alias("new"))
    both = prices.join(applied, "_id", "left")
    columns = {c: F.when(F.col("new"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in values}
    columns["updatedAt"] = F.when(F.col("new"), as_of).otherwise(F.col("updatedAt"))
    rejects = judged.where("status <> 200").select("edit_seq", "_id", "status", "message", "errors")
    return both.select(*(columns.get(c, F.col(c)).alias(c) for c in PRICES.names)), rejects


def apply_price_edits(prices: DataFrame, edits: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(prices, rejects)."""
    return _edited(prices, judge_price_edits(prices, edits), as_of)


def replayed(checked: DataFrame, ids: DataFrame, seq: str, key: Column, owners: DataFrame, missing: str, taken: str) -> DataFrame:
    """Checked requests (seq, _id, errors, ...) with the status and message that each gets when they are taken one after the other.

    ids: the table's (_id); owners: its (row, key); ``applied`` marks the last accepted request of a row."""
    found = save(checked.join(ids.select("_id", F.lit(True).alias("found")), "_id", "left"), "requests")
    valid = F.size("errors") == 0
    claims = found.where(valid & F.col("found")).select(F.col(seq).cast("long").alias("seq"), F.col("_id").alias("row"), key.alias("key"))
    settled = settle(claims, owners).withColumnRenamed("seq", "of")
    both = found.join(settled, F.col(seq) == F.col("of"), "left").drop("of")
    status = F.when(~valid, 400).when(F.col("found").isNull(), 404).when(~F.col("accepted"), 409).otherwise(200)
    said = F.when(status == 400, INVALID_INPUT).when(status == 404, missing).when(status == 409, taken)
    last = F.max(F.when(F.col("accepted"), F.col(seq))).over(among("good", seq, "_id"))
    judged = both.withColumn("good", F.coalesce("accepted", F.lit(False))).withColumns({"status": status, "message": said, "last": last})
    return judged.withColumn("applied", F.col("good") & (F.col(seq) == F.col("last")))


def replay_price_edits(prices: DataFrame, edits: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(prices, rejects) of edits taken one after the other by edit_seq, which is unique: an edit may take a key that an earlier one has freed,
    and is refused if another row has it by then."""
    checked = validate_prices(edits).withColumns({"newSymbol": normalize_symbol(F.col("symbol")), "newDate": utc_wall_time(parse_trade_date(F.col("tradeDate")))})
    owners = prices.select(F.col("_id").alias("row"), F.struct("symbol", "tradeDate").alias("key"))
    key = F.struct(F.col("newSymbol").alias("symbol"), F.col("newDate").alias("tradeDate"))
    return _edited(prices, replayed(checked, prices, "edit_seq", key, owners, NOT_FOUND, TAKEN), as_of)


def delete_by_id(table: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table without the ids, ids that it does not have)."""
    return table.join(ids, "_id", "left_anti"), ids.join(table, "_id", "left_anti").distinct()


def delete_prices(prices: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    kept, unknown = delete_by_id(prices, ids)
    return kept, unknown.withColumns({"status": F.lit(404), "message": F.lit(NOT_FOUND)})
