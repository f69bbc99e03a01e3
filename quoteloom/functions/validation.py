"""Checks that give each row its errors, as arrays of (field, message), and the status of failures."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ROLES, STATUSES
from .scalars import parse_number, parse_trade_date, trimmed

# The messages of the checks.
SYMBOL = "Symbol must be between 2 and 20 characters."
COMPANY = "Company name must be between 2 and 120 characters."
NOTES = "Notes cannot exceed 300 characters."
TRADE_DATE = "Enter a valid trade date."
PRICE = "{} must be a non-negative number."
PRICE_NAMES = {"open": "Open price", "high": "High price", "low": "Low price", "close": "Close price", "adjustedClose": "Adjusted close", "volume": "Volume"}
NAME = "Name must be 2 to 80 characters."
EMAIL = "Enter a valid email address."
ROLE = "Role must be either admin or user."
INVALID_INPUT = "Please correct the highlighted input errors."
MISSING = "Missing required CSV column. Expected one of: {}"
BAD_NUMBER = 'Invalid numeric value "{}" found in CSV.'
BAD_DATE = "Invalid trade date at CSV row {}."
#: Canonical column -> the headers that may name it.
ALIASES = {
    "tradeDate": ["tradeDate", "date", "tradingDate"],
    "open": ["open", "openingPrice"],
    "high": ["high", "highPrice"],
    "low": ["low", "lowPrice"],
    "close": ["close", "closingPrice"],
    "adjustedClose": ["adjustedClose", "adjClose"],
    "volume": ["volume", "tradeVolume"],
}

_FLOAT = r"^[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?$"
_ISO = r"^\d{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12]\d|3[01])([T ]([01]\d|2[0-3])(:[0-5]\d){0,2}([.,]\d+)?(Z|[+-]\d{2}(:?\d{2})?)?)?)?)?$"
_EMAIL = r"^[A-Za-z0-9._%+'-]+@([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}$"


def errors(*rules: tuple[Column, str, str]) -> Column:
    """Array of (field, message) of the rules (failed, field, message) that failed, in order."""
    found = [F.when(F.coalesce(failed, F.lit(True)), F.struct(F.lit(field).alias("field"), F.lit(message).alias("message"))) for failed, field, message in rules]
    return F.filter(F.array(*found), lambda e: e.isNotNull())


def length_outside(name: str, least: int, most: int) -> Column:
    return ~F.length(trimmed(F.coalesce(F.col(name).cast("string"), F.lit("")))).between(least, most)


def not_a_price(name: str) -> Column:
    text = F.coalesce(F.col(name).cast("string"), F.lit(""))
    return ~(text.rlike(_FLOAT) & (text.try_cast("double") >= 0))


def _header_rules() -> list[tuple[Column, str, str]]:
    return [(length_outside("symbol", 2, 20), "symbol", SYMBOL), (length_outside("companyName", 2, 120), "companyName", COMPANY)]


def _notes_rule() -> tuple[Column, str, str]:
    return (length_outside("notes", 0, 300), "notes", NOTES)


def validate_prices(df: DataFrame) -> DataFrame:
    """Rows of raw strings, with their errors; commas are not allowed here."""
    text = F.coalesce(F.col("adjustedClose").cast("string"), F.lit(""))
    rules = [*_header_rules(), (~F.col("tradeDate").cast("string").rlike(_ISO), "tradeDate", TRADE_DATE)]
    for name, said in PRICE_NAMES.items():
        failed = not_a_price(name) if name != "adjustedClose" else (text != "") & not_a_price(name)
        rules.append((failed, name, PRICE.format(said)))
    return df.withColumn("errors", errors(*rules, _notes_rule()))


def validate_users(df: DataFrame) -> DataFrame:
    rules = [(length_outside("name", 2, 80), "name", NAME), (~F.col("email").rlike(_EMAIL), "email", EMAIL), (~F.col("role").isin(ROLES), "role", ROLE)]
    return df.withColumn("errors", errors(*rules))


def validate_reports(df: DataFrame) -> DataFrame:
    rules = [
        (length_outside("stockSymbol", 2, 20), "symbol", SYMBOL),
        _header_rules()[1],
        (F.col("sizeBytes") < 1, "sizeBytes", "Size must be at least 1 byte."),
        (~F.col("processingStatus").isin(STATUSES), "processingStatus", "Unknown processing status."),
    ]
    return df.withColumn("errors", errors(*rules))


def validate_import_header(df: DataFrame) -> DataFrame:
    """Upload rows (symbol, companyName, notes), with their errors."""
    return df.withColumn("errors", errors(*_header_rules(), _notes_rule()))


def check_csv_rows(df: DataFrame) -> DataFrame:
    """Rows with canonical string columns and row_idx (from 0), with the first error of each, or null."""

    def missing(name: str) -> Column:
        return F.when(F.col(name).isNull(), MISSING.format(", ".join(ALIASES[name])))

    def bad(name: str) -> Column:
        before, after = BAD_NUMBER.split("{}")
        return F.when(parse_number(F.col(name))["bad"], F.concat(F.lit(before), F.col(name), F.lit(after)))

    steps = [missing("tradeDate")]
    for name in ("open", "high", "low", "close", "adjustedClose", "volume"):
        steps += [missing(name)] if name != "adjustedClose" else []
        steps.append(bad(name))
    before, after = BAD_DATE.split("{}")
    line = F.concat(F.lit(before), (F.col("row_idx") + 2).cast("string"), F.lit(after))
    return df.withColumn("error", F.coalesce(*steps, F.when(parse_trade_date(F.col("tradeDate")).isNull(), line)))


def collect_errors(df: DataFrame, key: str) -> DataFrame:
    """(key, messages): all messages of each failing record, in order; df has ``errors``."""
    each = df.select(F.col(key).alias("key"), F.posexplode("errors").alias("pos", "e"))
    listed = each.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", "e.message"))).alias("found"))
    return listed.select("key", F.col("found.message").alias("messages"))


def classify_failures(df: DataFrame) -> DataFrame:
    """(name, code, statusCode, message) -> the status and message of the answer; the first rule that fits counts."""
    upload = F.when(F.col("code") == "LIMIT_FILE_SIZE", "File upload must be 10MB or smaller.").otherwise("Please upload a valid file.")
    status = F.when(F.col("name") == "ValidationError", 400).when(F.col("code") == "11000", 409).when(F.col("name") == "MulterError", 400)
    said = F.when(F.col("name") == "ValidationError", "Validation failed.").when(F.col("code") == "11000", "A record with this unique value already exists.").when(F.col("name") == "MulterError", upload)
    own = F.when(F.coalesce(F.col("message"), F.lit("")) == "", "Internal server error.").otherwise(F.col("message"))
    given = F.when(F.coalesce(F.col("statusCode"), F.lit(0)) == 0, 500).otherwise(F.col("statusCode"))
    return df.withColumns({"status": F.coalesce(status, given).cast("int"), "answer": F.coalesce(said, own)})
