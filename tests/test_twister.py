"""Jumps in Python's generator, and the seeded bootstrap over many ranges of its words."""

import random

import numpy as np
import pytest

from trailmill.functions import twister
from trailmill.operators import precision as P


@pytest.mark.parametrize("start", [0, 1, 623, 624, 39936, 40001, 3_000_000])
@pytest.mark.parametrize("seed", [0, 20260730])
def test_jumps(seed, start):
    made = random.Random(seed)
    if start:
        made.getrandbits(32 * start)
    assert twister.at(seed, start).random_raw(700).tolist() == [made.getrandbits(32) for _ in range(700)]


@pytest.mark.parametrize(("n", "at_once"), [(33, 1 << 24), (33, 10), (64, 64), (1, 1)])
def test_replicates_over_many_ranges(spark, monkeypatch, n, at_once):
    monkeypatch.setattr(P, "_RANGE", 1000)
    monkeypatch.setattr(P, "SEEDS_AT_ONCE", at_once)
    rng, made = random.Random(n), random.Random(P.SEED)
    deltas = [rng.uniform(-1, 1) for _ in range(n)]
    want = [sum(made.choice(deltas) for _ in deltas) / n for _ in range(700)]
    rows = spark.createDataFrame(rng.sample([(10 * k, d) for k, d in enumerate(deltas)], n), "seed_id long, delta double")
    got = {r["replicate"]: r["mean"] for r in P.seeded_replicates(rows, 700).collect()}
    assert sorted(got) == list(range(700)) and all(abs(got[k] - m) < 1e-12 for k, m in enumerate(want))


def test_more_than_a_million_seeds(spark):
    n = 1_000_003
    rows = spark.range(n).selectExpr("id AS seed_id", "CAST(id % 1000 AS DOUBLE) AS delta")
    got = [r["mean"] for r in P.seeded_replicates(rows, 3).orderBy("replicate").collect()]
    places = np.concatenate(list(P.choices(P.SEED, n, 0, 3 * n))).reshape(3, n)
    assert got == pytest.approx((places % 1000).mean(axis=1).tolist(), abs=1e-9)
