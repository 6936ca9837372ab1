"""Sums of weights against fractions: one task adds equal numbers often enough for a running sum to lose the fourth digit."""

from fractions import Fraction

from pyspark.sql import functions as F

from trailmill.functions.numeric import exact_sum
from trailmill.operators import policy as P


def test_effective_samples(spark):
    n = 2_000_004
    rows = spark.range(0, n, 1, 1).select(F.lit(P.SINGLE).alias("mode"), F.lit(P.SINGLE).alias("target"), F.lit(0.5).alias("reward"), F.when(F.col("id") % 5 == 0, 0.25).otherwise(0.75).alias("probability"), F.lit(True).alias("exploration"))
    four = -(-n // 5)
    want = Fraction(3 * four + n - four) ** 2 / (9 * four + n - four)
    assert P.snips(rows).first()["effective_samples"] == round(float(want), 4)


def test_any_order_and_none(spark):
    values = [20.0, 4 / 3, 1e-9, 0.0, 19.999999999, 1.1] * 50
    want = float(sum(map(Fraction, values)))
    for parts in (1, 3):
        got = spark.createDataFrame([(v,) for v in values], "v double").repartition(parts).agg(exact_sum(F.col("v"), 20.0).alias("s")).first()["s"]
        assert abs(got - want) <= abs(want) * 2**-52
    assert spark.createDataFrame([(None,)], "v double").agg(exact_sum(F.col("v"), 20.0).alias("s")).first()["s"] == 0.0
