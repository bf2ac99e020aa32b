"""Queries of this subpackage, opN_<name>, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, table
from . import chat, embeddings, hard_negatives, lines, media, mixing, ngram_join, packing, quality, substrings, toxicity, warc, whitening


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(prepare(spark), sf_dir, "pages"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(prepare(spark), sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.probe(media.to_media(table(prepare(spark), sf_dir, "documents")))
    first, last = F.get("keyframes", F.lit(0)), F.try_element_at("keyframes", F.lit(-1))
    feature = F.format_string("%s|%.6f|%d|%d|%d+%d|%d+%d", "codec", "seconds", "samples", F.size("keyframes"), first["offset"], first["bytes"], last["offset"], last["bytes"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "codec", "seconds", "keyframes")


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(prepare(spark), sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(prepare(spark), sf_dir, "documents"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs, with_text=False).select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(prepare(spark), sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % hard_negatives.MISLABEL_STEP == 0, (F.col("label") + 1) % hard_negatives.LABELS).otherwise(F.col("label"))
    return hard_negatives.mine(table(prepare(spark), sf_dir, "embeddings"), label=label)


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_lines(table(prepare(spark), sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_ngram_join, op3_toxicity, op4_media, op5_embeddings, op6_packing, op7_substrings, op8_mixing, op9_chat, op10_quality, op11_whitening, op12_hard_negatives, op13_lines)}
ORACLES = {"op5_embeddings": embeddings.ORACLE, "op8_mixing": mixing.ORACLE, "op9_chat": chat.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE, "op13_lines": lines.ORACLE}
