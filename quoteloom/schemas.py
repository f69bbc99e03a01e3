"""Columns of the three tables.  "Not null" and "not negative" are rules of the checks, not of the types: the CSV import
keeps values that an edit would refuse."""

from pyspark.sql import types as T


def _table(text: str) -> T.StructType:
    kinds = {"string": T.StringType(), "double": T.DoubleType(), "long": T.LongType(), "time": T.TimestampNTZType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (c.split() for c in text.split(", "))])


PRICES = _table(
    "_id string, symbol string, companyName string, tradeDate time, open double, high double, low double, close double, "
    "adjustedClose double, volume double, source string, notes string, createdBy string, createdAt time, updatedAt time"
)
USERS = _table("_id string, name string, email string, role string, lastLoginAt time, createdAt time, updatedAt time")
REPORTS = _table(
    "_id string, stockSymbol string, companyName string, originalFilename string, storedFilename string, mimeType string, "
    "sizeBytes long, storagePath string, processingStatus string, summary string, uploadedBy string, createdAt time, updatedAt time"
)

PRICE_VALUES = ["open", "high", "low", "close", "adjustedClose", "volume"]
#: What an import sets on a row whether it is new or not.
IMPORTED = ["companyName", *PRICE_VALUES, "notes", "source", "createdBy"]
ROLES = ["admin", "user"]
STATUSES = ["uploaded", "queued", "processed", "failed"]
