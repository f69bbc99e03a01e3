"""Training-data pipeline over ``documents``: toxic documents go, lines that recur across documents go, one document
of each group of near-duplicates stays, sources are mixed to target weights, and the rest is packed into sequences.

A stage takes (spark, docs, sf_dir), docs being what its predecessor kept, and returns a DataFrame; all but the last
return the columns of ``documents``.  Each stage's result is written and read again.

Line dedup comes before near-dedup, as the order is given.  The first document of a group of copies keeps its text, the others
lose the lines that they share with it, so near-dedup meets remnants of copies rather than copies, and empty texts, which
it links with nothing and mixing takes no words of.

Edge cases: null and empty texts pass all filters and end as a piece that holds the end id alone, unless mixing takes them 0 times,
as it does texts without words; rows without doc_id are judged by toxicity, untouched by the two dedup stages, and
mixed and packed; repeated rows of a doc_id stay repeated up to mixing; an empty table gives no pieces; further columns
go along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quoteloom.llm import linededup, minhash, mixing, packing, toxicity
from quoteloom.llm.common import save, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.drop_recurring_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, mixing.quality_weights(table(spark, sf_dir, "labels")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_recurring_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned weights, MinHash components and BPE ids have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on ``documents``; each stage's result is a written table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    return docs
