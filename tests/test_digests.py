"""Leading words of digests against hashlib, and draws that cost little more than their hashes."""

import hashlib
import random

import numpy as np
import pytest

from trailmill.functions.digests import leading_words


@pytest.mark.parametrize("seed", ["release", "", "ü" * 20, "x" * 43, "x" * 60])
def test_words_are_hashlibs(seed):
    made = random.Random(len(seed))
    pairs = [(made.randrange(10 ** made.randint(1, 6)), made.randrange(10 ** made.randint(1, 12))) for _ in range(500)] + [(0, 0), (9, 10), (99, 100), (10**5, 10**9), (10**9, 2**32), (2**32, 10**10)]
    b, i = (np.array(x) for x in zip(*pairs, strict=True))
    assert leading_words(seed, b, i).tolist() == [int(hashlib.sha256(f"{seed}|{x}|{y}".encode()).hexdigest()[:8], 16) for x, y in pairs]


def test_draws_are_summed_where_they_are_made(spark):
    """No row of the plan is a draw: blocks go in, and a sum for each replicate of a block comes out."""
    from pyspark.sql import functions as F

    from trailmill.operators import evaluation as E

    pairs = spark.range(2000).select(F.col("id").alias("case_id"), (F.col("id") % 7 / 10.0).alias("delta"))
    out = E.bootstrap(pairs, 50, "s")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "sha2" not in plan and "step=1," not in plan
    assert out.first()["replicates"] == 50


def test_pairs_without_a_delta_count_for_numbers_only(spark):
    from trailmill.operators import evaluation as E

    deltas = [None if k % 3 == 0 else k / 10 for k in range(12)]
    rows = spark.createDataFrame(list(enumerate(deltas)), "case_id long, delta double")
    means = []
    for b in range(30):
        drawn = [deltas[int(hashlib.sha256(f"s|{b}|{i}".encode()).hexdigest()[:8], 16) % 12] for i in range(12)]
        means.append(sum(x for x in drawn if x is not None) / sum(x is not None for x in drawn))
    one, two = (E.bootstrap(rows, 30, "s", most).first() for most in (2, 1000))
    assert one == two and one["above"] == pytest.approx(sum(m > 0 for m in means) / 30)
    assert one["high"] == pytest.approx(float(np.quantile(means, 0.975)), abs=1e-6)
