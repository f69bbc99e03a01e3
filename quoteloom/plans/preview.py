"""Insight previews: a request, the newest data of its symbol and its report, as status and module rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.reports import latest_report_for

PAYLOAD = "generatedAt string, reportId string, selectedSymbol string"


def parse_preview_request(df: DataFrame, json: str = "json", state: str | None = None) -> DataFrame:
    """Adds generatedAt, reportId and selectedSymbol; a state struct wins over the stored JSON, broken JSON is none."""
    parsed = F.from_json(F.col(json), PAYLOAD)
    chosen = F.coalesce(F.col(state), parsed) if state else parsed
    return df.withColumn("__p", chosen).select(*df.columns, F.col("__p.generatedAt").alias("generatedAt"), F.col("__p.reportId").alias("reportId"), F.col("__p.selectedSymbol").alias("selectedSymbol"))


def _joined(requests: DataFrame, universe: DataFrame, reports: DataFrame) -> DataFrame:
    """Requests with ``stock`` and ``report`` structs, null where there is none."""
    stock = universe.select(F.col("symbol").alias("selectedSymbol"), F.struct("symbol", "companyName", "recordCount").alias("stock"))
    asked = requests.select("request_id", "userId", "reportId", "selectedSymbol")
    return latest_report_for(asked, reports).join(stock, "selectedSymbol", "left")


def _or(value: Column, other: str | Column) -> Column:
    """The value unless it is null or blank, as a script's || does."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(other) if isinstance(other, str) else other)


def pipeline_status(requests: DataFrame, universe: DataFrame, reports: DataFrame) -> DataFrame:
    """Four rows a request: (request_id, position, label, status)."""
    has = F.coalesce(F.col("selectedSymbol") != "", F.lit(False))
    # Labels and states.
    rows = [
        ("Stock data", F.when(F.col("stock").isNotNull(), "Ready").otherwise("Waiting")),
        ("Report intake", _or(F.col("report.processingStatus"), "Optional")),
        ("Sentiment", F.when(has, "Prepared").otherwise("Pending")),
        ("XAI insight", F.when(has, "Preparing").otherwise("Waiting")),
    ]
    made = F.array(*(F.struct(F.lit(label).alias("label"), status.alias("status")) for label, status in rows))
    return _joined(requests, universe, reports).select("request_id", F.posexplode(made).alias("position", "r")).select("request_id", "position", "r.*")


def component_outputs(requests: DataFrame, universe: DataFrame, reports: DataFrame) -> DataFrame:
    """Five rows a request: (request_id, code, title, status, tone, output, input, evidence)."""
    has = F.coalesce(F.col("selectedSymbol") != "", F.lit(False))
    stock, report = F.col("stock").isNotNull(), F.col("report").isNotNull()
    name = F.col("stock.companyName")

    def pick(when: Column, then, other) -> Column:
        as_column = lambda v: F.lit(v) if isinstance(v, str) else v
        return F.when(when, as_column(then)).otherwise(as_column(other))

    checked = F.concat(F.col("stock.recordCount").cast("string"), F.lit(" market records checked."))
    # The modules' texts; code, title, status, tone, output, input, evidence.
    modules = [
        ("01", "Stock Data Component", pick(stock, "Available", "Waiting"), pick(stock, "ready", "pending"), _or(F.col("stock.symbol"), "No stock selected"), _or(name, "Company selection required"), pick(stock, checked, "Return to controls and select a company.")),
        ("02", "Financial Report Component", pick(report, F.col("report.processingStatus"), "Optional"), pick(report, "queued", "pending"), _or(F.col("report.originalFilename"), "No report uploaded"), _or(F.col("report.companyName"), _or(name, "PDF report optional")), pick(report, "Report is queued for document parsing.", "Preview generated without a financial report.")),
        ("03", "Sentiment Component", pick(has, "Prepared", "Pending"), pick(has, "ready", "pending"), pick(has, "Market sentiment signal prepared", "Not generated"), _or(name, "Company selection required"), pick(has, "Market context prepared as a separate signal.", "Generate preview to prepare this output.")),
        ("04", "Risk Component", pick(has, "Calculated", "Pending"), pick(has, "ready", "pending"), pick(has, "Moderate risk level", "Not generated"), _or(F.col("stock.symbol"), "Stock data required"), pick(has, "Uncertainty is separated from the final insight.", "Risk output appears after setup.")),
        ("05", "Explainable AI Component", pick(has, "Prepared", "Waiting"), pick(has, "ready", "pending"), pick(has, "Top contributing factors identified", "Not generated"), F.lit("Stock, report, sentiment, and risk outputs"), pick(has, "Key factors are ready for explanation.", "XAI output appears after preview generation.")),
    ]
    fields = ["code", "title", "status", "tone", "output", "input", "evidence"]
    structs = [F.struct(*((F.lit(v) if isinstance(v, str) else v).alias(f) for f, v in zip(fields, m, strict=True))) for m in modules]
    return _joined(requests, universe, reports).select("request_id", F.explode(F.array(*structs)).alias("m")).select("request_id", "m.*")
