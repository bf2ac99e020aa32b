"""Paired tests against exact integers."""

from fractions import Fraction
from math import comb

from pyspark.sql import functions as F

from docloom.operators import evaluate


def exact(wins, losses):
    n = wins + losses
    return float(min(Fraction(1), Fraction(2 * sum(comb(n, i) for i in range(min(wins, losses) + 1)), 2**n)))


def test_binomial_p_at_any_size(spark):
    pairs = [(0, 0), (0, 1), (1, 7), (8, 8), (3, 12), (400, 460), (537, 538), (0, 1200), (1100, 1), (600, 700), (2000, 2000), (2400, 2550), (2550, 2400), (3000, 3300), (6000, 6100)]
    df = spark.createDataFrame(pairs, "w long, l long")
    for r in df.select("w", "l", evaluate.binomial_p(F.col("w"), F.col("l")).alias("p")).collect():
        assert abs(r["p"] - exact(r["w"], r["l"])) <= 1e-10 * exact(r["w"], r["l"]) + 1e-300, r


def test_paired_with_thousands_of_discordant_questions(spark):
    a = spark.range(5000).select(F.lit("a").alias("system"), F.col("id").alias("query_id"), F.when(F.col("id") < 2400, 1).alias("rank"))
    b = spark.range(5000).select(F.lit("b").alias("system"), F.col("id").alias("query_id"), F.when(F.col("id") >= 2450, 2).alias("rank"))
    row = evaluate.paired(a.unionByName(b)).first()
    assert (row["hit_wins"], row["hit_losses"], row["rank_wins"], row["rank_losses"]) == (2400, 2550, 2400, 2550)
    assert row["hit_p"] == row["rank_p"] == round(exact(2400, 2550), 6) > 0.03
