"""Report intake records and the newest few of each uploader."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import blank_to_null, normalize_symbol, stored_filename, trimmed
from ..schemas import REPORTS
from .prices import new_id

RECENT = 8
# Texts of the intake record and its refusals.
SUMMARY = "Report received and queued for document parsing, indicator extraction, and explainable insight generation."
INCOMPLETE = "Company name and stock symbol are required."
NO_FILE = "Please upload a PDF report."


def report_public(reports: DataFrame) -> DataFrame:
    return reports.select("_id", "stockSymbol", "companyName", "originalFilename", "mimeType", "sizeBytes", "processingStatus", "summary", F.col("createdAt").alias("uploadedAt"))


def recent_reports(reports: DataFrame, n: int = RECENT) -> DataFrame:
    """The newest n of each uploader; the rank filter is applied before the shuffle too, so no uploader is too large."""
    order = Window.partitionBy("uploadedBy").orderBy(F.desc("createdAt"), F.desc("_id"))
    return reports.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def report_intake(files: DataFrame, uploads: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(report rows, rejects).  files: (path, length, accepted, reject_reason); uploads: (path, originalFilename,
    mimeType, symbol, companyName, userId, epoch_ms)."""
    both = uploads.join(files, "path", "left")
    symbol, company = blank_to_null(normalize_symbol(F.col("symbol"))), blank_to_null(trimmed(F.col("companyName")))
    both = both.withColumns({"stockSymbol": symbol, "companyName": company})
    refused = F.when(~F.col("accepted"), F.col("reject_reason"))
    reason = F.coalesce(refused, F.when(F.col("stockSymbol").isNull() | F.col("companyName").isNull(), INCOMPLETE), F.when(F.col("length").isNull(), NO_FILE))
    both = both.withColumn("reason", reason)
    stored = stored_filename(F.col("originalFilename"), F.col("epoch_ms"))
    made = {
        "_id": new_id(F.col("path"), F.col("userId")),
        "storedFilename": stored,
        "sizeBytes": F.col("length"),
        "storagePath": F.col("path"),
        "processingStatus": F.lit("queued"),
        "summary": F.lit(SUMMARY),
        "uploadedBy": F.col("userId"),
        "createdAt": as_of,
        "updatedAt": as_of,
    }
    rows = both.where("reason is null").select(*(made.get(c, F.col(c)).alias(c) for c in REPORTS.names))
    return rows, both.where("reason is not null").select("path", F.lit(400).alias("status"), F.col("reason").alias("message"))


def latest_report_for(requests: DataFrame, reports: DataFrame) -> DataFrame:
    """requests (request_id, userId, reportId, selectedSymbol) with ``report``: of the user's newest few the one that is
    asked for by id, else the newest of the symbol, else null."""
    recent = recent_reports(reports).select(F.col("uploadedBy").alias("userId"), F.struct("_id", "createdAt", "stockSymbol", "companyName", "originalFilename", "processingStatus").alias("r"))
    by_id = F.coalesce(F.col("r._id") == F.col("reportId"), F.lit(False))
    fits = by_id | F.coalesce(F.col("r.stockSymbol") == F.col("selectedSymbol"), F.lit(False))
    both = requests.join(recent, "userId", "left")
    best = F.max_by(F.when(fits, F.col("r")), F.when(fits, F.struct(by_id.alias("by_id"), "r.createdAt", "r._id")))
    return both.groupBy(*requests.columns).agg(best.alias("report"))
