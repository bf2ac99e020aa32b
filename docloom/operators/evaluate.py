"""Retrieval metrics, exact paired tests, and summaries of routing, judging and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE_BITS = 500
SCALE = 0.5**SCALE_BITS


def first_hits(ranking: DataFrame, truth: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, rank): the first relevant rank, null for a miss."""
    hits = ranking.join(truth, ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return questions.select("query_id").join(hits, "query_id", "left")


def first_pages(ranking: DataFrame, expected: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, rank): the first rank whose (doc_id, page) is expected, null for a miss."""
    hits = ranking.join(expected, ["query_id", "doc_id", "page"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return questions.select("query_id").join(hits, "query_id", "left")


def hit(rank: str, k: int) -> Column:
    return F.coalesce((F.col(rank) <= k).cast("int"), F.lit(0))


def summary(ranks: DataFrame, by: list[str]) -> DataFrame:
    reciprocal = F.when(F.col("rank") <= 10, 1.0 / F.col("rank")).otherwise(0.0)
    return ranks.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(hit("rank", 1)), 6).alias("hit1"), F.round(F.avg(hit("rank", 5)), 6).alias("hit5"), F.round(F.avg(reciprocal), 6).alias("mrr10"))


def binomial_p(wins: Column, losses: Column) -> Column:
    """Exact two-sided sign test; 1 without any pair.

    Binomial coefficients are built by a product from 1; they and their sum are brought down by SCALE, a power of two,
    whenever they pass 1 / SCALE, so counts of any size neither overflow nor vanish.
    """
    n, low = wins + losses, F.least(wins, losses)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("tail"), F.lit(0).cast("long").alias("scaled"))

    def step(s: Column, i: Column) -> Column:
        term, tail = s["term"] * (n - i) / (i + 1), s["tail"] + s["term"]
        down = F.greatest(term, tail) > 1 / SCALE
        factor = F.when(down, SCALE).otherwise(1.0)
        return F.struct((term * factor).alias("term"), (tail * factor).alias("tail"), (s["scaled"] + down.cast("long")).alias("scaled"))

    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), low.cast("long")), start, step, lambda s: s["tail"] * F.pow(F.lit(2.0), SCALE_BITS * s["scaled"] - n))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def paired(ranks: DataFrame, k: int = 5, depth: int = 10) -> DataFrame:
    """ranks (system, query_id, rank) -> one row per pair of systems with hit and rank wins, losses and p."""
    a, b = (ranks.select(F.col("system").alias(f"system_{x}"), "query_id", F.col("rank").alias(f"rank_{x}")) for x in "ab")
    both = a.join(b, "query_id").where("system_a < system_b")
    deep = lambda c: F.when(F.col(c) <= depth, F.col(c)).otherwise(depth + 1)
    hit_a, hit_b, ra, rb = hit("rank_a", k), hit("rank_b", k), deep("rank_a"), deep("rank_b")
    out = both.groupBy("system_a", "system_b").agg(
        F.count_if(hit_a > hit_b).alias("hit_wins"), F.count_if(hit_a < hit_b).alias("hit_losses"), F.count_if(ra < rb).alias("rank_wins"), F.count_if(ra > rb).alias("rank_losses")
    )
    return out.withColumn("hit_p", F.round(binomial_p(F.col("hit_wins"), F.col("hit_losses")), 6)).withColumn("rank_p", F.round(binomial_p(F.col("rank_wins"), F.col("rank_losses")), 6))


def pairs(systems: DataFrame) -> DataFrame:
    """(system_a, system_b): every two systems once. There are a handful of systems."""
    a, b = systems.select(F.col("system").alias("system_a")), systems.select(F.col("system").alias("system_b"))
    return a.join(b, F.col("system_a") < F.col("system_b"))


def medians(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, middle, lower, upper): the usual median, and those of the lower and the upper of two middle values."""
    lower, upper = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})"), F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)")
    found = rows.groupBy(*by).agg(lower.alias("lower"), upper.alias("upper"))
    return found.select(*by, F.round((F.col("lower") + F.col("upper")) / 2, 6).alias("middle"), "lower", "upper")
