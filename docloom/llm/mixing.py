"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Documents of a source are shuffled by the MD5 of their id and text. A document's virtual finish time is the source's cumulative
tokens up to its end, divided by the source's target; the source is read again from its start, up to MAX_EPOCHS times.
In global order of virtual time the mix is cut at the total budget. Targets add up to that budget, so the cut falls at
virtual time 1, and the document in service there is taken in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stash

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Hex digits of a document's shuffle key that name its bucket; sums of buckets are added up first, then rows within one.
BUCKET_DIGITS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> (source, source_size, target): shares by weight, none above MAX_EPOCHS times its size."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*map(F.lit, WEIGHTS))
    rows = sizes.withColumn("weight", F.element_at(cycle, (rank - 1) % len(WEIGHTS) + 1)).withColumn("cap", MAX_EPOCHS * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    # the first row in the window's order: of sources that tie, only the first has a level with all of them uncapped
    first = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("place", "level"))).over(whole)["level"]
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("level", level).withColumn("level", first)
    return rows.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0))).alias("target"))


def _served(rows: DataFrame) -> DataFrame:
    """rows (uid, id, source, size, shuffle) with source_size, target, taken and virtual_finish; thin rows only."""
    rows = stash(rows.withColumn("bucket", F.substring("shuffle", 1, BUCKET_DIGITS)), "mix")
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("ahead", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)))
    buckets = buckets.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.source", "bucket", "ahead", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("shuffle", "id", "size", "uid").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    at = rows.alias("r").join(buckets.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.bucket") == F.col("b.bucket"))).select("r.*", "ahead", "source_size", "target")
    start, budget = F.col("ahead") + F.col("inside"), F.floor(F.col("target") + 1e-6).cast("long")
    served = [F.least(F.greatest(budget - (start + e * F.col("source_size")), F.lit(0).cast("long")), F.col("size")) for e in range(MAX_EPOCHS)]
    finish = F.coalesce(F.try_divide(start + F.col("size"), F.col("target")), F.lit(0.0))
    return at.select("uid", "id", "size", "source_size", "target", sum(served[1:], served[0]).alias("taken"), finish.alias("virtual_finish"))


def _thin(uid: Column, name: Column, text: Column, source: Column) -> list[Column]:
    shuffle = F.md5(F.concat(F.coalesce(name.cast("string"), F.lit("")), F.md5(F.coalesce(text.cast("string"), F.lit("")))))
    return [uid.alias("uid"), name.alias("id"), source.cast("string").alias("source"), words(text).alias("size"), shuffle.alias("shuffle")]


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """Every document with id, size (words), source_size, target, taken (words, repeats counted) and virtual_finish, in
    global order of virtual finish time.

    taken of a source adds up to its target, rounded down. Nulls: a null text or one without words has size 0 and takes
    nothing; a null source is a source of its own, the last; a null id is shuffled by its text alone. Rows that repeat
    an id are documents of their own. Ties in the shuffle go by id, size, then any order. With no words at all every
    target is 0; an empty table gives no rows. Very long texts weigh by their words like all others. Other columns are
    dropped, whatever their names. Targets are solved in one task over one row per source.
    """
    out = _served(docs.select(*_thin(F.monotonically_increasing_id(), F.col(id_column), F.col(text_column), F.col(source_column))))
    return out.drop("uid").withColumnRenamed("id", id_column).orderBy("virtual_finish", id_column)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of documents, each as often as the mix reads it; one that the budget cuts goes in whole.

    Texts do not take part in the mix: rows are written once with a number, and the documents taken are found by it.
    Nulls, ties, repeats and empty tables are as in mix; columns of docs may have any names and stay as they are.
    """
    rows = stash(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("uid")), "documents")
    taken = _served(rows.select(*_thin(F.col("uid"), F.col("row.doc_id"), F.col("row.text"), F.col("row.source")))).where("taken > 0")
    copies = taken.select("uid", F.expr("int(ceil(taken / size))").alias("copies"))
    return rows.join(copies, "uid").withColumn("copy", F.explode(F.expr("sequence(1, copies)"))).select("row.*")


ORACLE = """
WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS h, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
m AS (SELECT arg_min(level, cap / weight) AS level FROM l WHERE level <= cap / weight),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(m.level * weight, 0.0)) AS target FROM l LEFT JOIN m ON true),
a AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || h), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
SELECT doc_id, size, t.source_size, t.target, CAST(least(greatest(floor(target + 1e-6) - start, 0), size) + least(greatest(floor(target + 1e-6) - start - source_size, 0), size)
  + least(greatest(floor(target + 1e-6) - start - 2 * source_size, 0), size) AS BIGINT) AS taken
FROM a JOIN t ON a.source IS NOT DISTINCT FROM t.source
"""
