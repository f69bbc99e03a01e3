"""One query for each numbered operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linededup, lm, media, merkle, minhash, mixing, packing, tokencount, tokenfile, topk, toxicity, warc, whitening
from .common import save, table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op2_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op3_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 10 = 0")
    return lm.scores(table(spark, sf_dir, "documents"), training=~held_out).withColumn("held_out", held_out)


def op4_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.quality_weights(table(spark, sf_dir, "labels")))


def op7_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4")
    score = toxicity.scorer(docs, table(spark, sf_dir, "labels"), learn_from=fold != 2)
    scored = docs.select("doc_id", (fold == 2).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op8_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 20 == 0)


def op9_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    # written to the shared folder first: what is read back are the stored bytes
    read = media.read_media(save(media.write_media(table(spark, sf_dir, "documents")), "media", "zstd"))
    feature = F.concat_ws(":", F.concat_ws("x", "width", "height"), "thumbnail_hash")
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_elias_fano_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 7 = 0")
    return merkle.audit(table(spark, sf_dir, "documents"), claims={"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_trie_token_counts,
        op3_lattice_lm,
        op4_warc_salvage,
        op5_line_dedup,
        op6_source_mixing,
        op7_toxicity_ftrl,
        op8_threshold_top_k,
        op9_jpeg_media,
        op10_best_fit_packing,
        op11_embedding_whitening,
        op12_elias_fano_tokens,
        op13_merkle_manifest,
    )
}

ORACLE: dict[str, str] = {
    "op1_minhash_near_dedup": minhash.ORACLE,
    "op4_warc_salvage": warc.ORACLE,
    "op5_line_dedup": linededup.ORACLE,
    "op6_source_mixing": mixing.ORACLE,
    "op8_threshold_top_k": topk.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
