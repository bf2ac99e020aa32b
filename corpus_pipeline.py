"""A training corpus from documents: quality, near-copies, repeated passages, source mix, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import mixing, ngram_join, packing, quality, substrings
from docloom.llm.scratch import stash
from docloom.session import prepare, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble predicts as good, unchanged.

    In every stage columns of documents may have any names beside doc_id, text and source, a null text is an empty one
    (judged like it here), very long texts are read whole, rows that repeat stay rows of their own, and an empty table
    gives no rows.
    """
    rules = quality.train(docs, table(prepare(spark), sf_dir, "labels"))
    return quality.keep_good(docs, rules)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join: that of least doc_id, then least text hash.

    Null and empty texts link with nothing and stay; of rows that repeat doc_id and text one stays.
    """
    prepare(spark)
    return ngram_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated runs of words; the words left are joined by single spaces.

    A null or empty text becomes or stays empty; a document of which nothing is left stays with an empty text; what
    repeated rows share goes from each of them. n_chars follows the text.
    """
    prepare(spark)
    rows = substrings.remove_repeats(docs)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return rows.select(*((new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weighted fair queue reads them within the budget; those without words are not read.

    Null sources are a source of their own; ties in the shuffle go by doc_id, then size.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences along the Hilbert curve; of an empty text the end id alone.

    Ties on the curve go by doc_id; rows that repeat, or have no doc_id, are documents of their own.
    """
    prepare(spark)
    return packing.pack(docs)


STAGES = [("quality_classifier", quality_classifier), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("source_mix", source_mix), ("packing", pack_sequences)]

#: Learning, hashing and tokenizing have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
