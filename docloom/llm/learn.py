"""Bounded samples of labelled documents, and held-out marks by the CRC of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_column: str, modulus: int) -> Column:
    return F.crc32(F.col(id_column).cast("string")) % modulus


def held_out(id_column: str, modulus: int, rest: int) -> Column:
    """False for null ids, which no label can name."""
    return F.coalesce(remainder(id_column, modulus) == rest, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, rest: int, per_class: int, id_column: str = "doc_id") -> DataFrame:
    """(id, text, y): at most per_class documents of each class, by hash order of the id; none held out.

    An id labelled more than once has its greatest label. Of several rows with one id only that with the least text
    hash comes, so at most 2 * per_class rows leave here.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg((F.max(label) > 0).cast("int").alias("y"))
    known = known.where(remainder("__id", modulus) != rest).withColumn("__h", F.xxhash64("__id"))
    some = [known.where(F.col("y") == y).orderBy("__h", "__id").limit(per_class) for y in (0, 1)]
    some = some[0].unionByName(some[1]).select("__id", "y")  # at most 2 * per_class thin rows
    rows = docs.select(F.col(id_column).alias("__id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(some), "__id")
    one = rows.groupBy("__id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return one.select(F.col("__id").alias(id_column), "text", "y")
