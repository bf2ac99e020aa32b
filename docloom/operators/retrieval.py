"""Lexical and dense retrieval over tables of passages and queries, for all queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B, RRF_K = 1.5, 0.75, 60
#: Dimensions of hash embeddings.
BUCKETS = 256


def postings(passages: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, term, tf), with partial counts before the shuffle."""
    return passages.select(F.col(id_column).alias("id"), F.explode(tokens(F.col(text_column))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def rank(rows: DataFrame, score: str = "score", query: str = "query_id", key: str = "id", k: int | None = None) -> DataFrame:
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(key))))
    return out if k is None else out.where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.coalesce(F.nullif(norm, F.lit(0.0)), F.lit(1.0)))


def hash_bucket(term: Column) -> Column:
    """The first byte of a term's MD5."""
    return F.conv(F.substring(F.md5(term), 1, 2), 16, 10).cast("int")


def hash_embedding(passages: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, bucket, n): how many terms of a passage fall into each bucket that has any; terms are not shuffled."""
    buckets = F.transform(tokens(F.col(text_column)), hash_bucket)
    return passages.select(F.col(id_column).alias("id"), F.explode(buckets).alias("bucket")).groupBy("id", "bucket").agg(F.count("*").alias("n"))


def fuse(rankings: list[DataFrame], k: int | None = 20) -> DataFrame:
    """Reciprocal rank fusion of rankings (query_id, id, rank); a list may come twice. Ties keep first-seen order."""
    parts = [r.select("query_id", "id", "rank", F.lit(n).alias("list")) for n, r in enumerate(rankings)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    scored = rows.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 8).alias("score"), F.min(F.struct("list", "rank")).alias("seen"), *(F.min(F.when(F.col("list") == n, F.col("rank"))).alias(f"rank_{n}") for n in range(len(rankings))))
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "seen.list", "seen.rank")))
    out = out if k is None else out.where(F.col("rank") <= k)
    return out.drop("seen")


def missing(passages: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return passages.join(stored.select(key), key, "left_anti")


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Upsert by key: the last row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")
