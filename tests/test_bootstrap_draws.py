"""The draws of the hash bootstrap: not folded into the plan, and the same whether pairs are broadcast or joined by number."""

import hashlib

import pytest
from pyspark.sql import functions as F

from trailmill.operators import evaluation as E


@pytest.mark.parametrize("broadcast_pairs", [2, 1000])
def test_draws_by_brute_force(spark, broadcast_pairs):
    deltas = [((k * 37) % 101 - 40) / 1000 for k in range(60)]
    got = E.bootstrap(spark.createDataFrame([(3 * k, d) for k, d in enumerate(deltas)], "case_id long, delta double"), 40, "s", broadcast_pairs).first()
    means = sorted(round(sum(deltas[int(hashlib.sha256(f"s|{b}|{i}".encode()).hexdigest()[:8], 16) % 60] for i in range(60)) / 60, 8) for b in range(40))
    at = lambda p: means[int(39 * p)] + (39 * p - int(39 * p)) * (means[int(39 * p) + 1] - means[int(39 * p)])
    assert (got["n"], got["replicates"]) == (60, 40)
    assert got["low"] == pytest.approx(at(0.025), abs=2e-6) and got["high"] == pytest.approx(at(0.975), abs=2e-6)
    assert got["above"] == pytest.approx(sum(m > 0 for m in means) / 40, abs=1e-6)


def test_the_plan_holds_no_draws(spark):
    pairs = spark.range(20_000).select(F.col("id").alias("case_id"), (F.col("id") % 7 / 10.0).alias("delta"))
    plan = E.bootstrap(pairs, 10, "s")._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "Range (0, 200000" in plan
