"""The seeded bootstrap against Python's own generator, and the gates."""

import random

import numpy as np
import pytest

from trailmill.operators import precision as P
from trailmill.queries.precision import _parts, precision_validation

FOLDER = "/root/testdata/sf0.001"


def replicates(deltas, draws, seed):
    made = random.Random(seed)
    return [sum(made.choice(deltas) for _ in deltas) / len(deltas) for _ in range(draws)]


def percentile(values, share):
    ordered = sorted(values)
    return ordered[max(0, min(int(round((len(ordered) - 1) * share)), len(ordered) - 1))]


@pytest.mark.parametrize("seed", [0, 1, 20260730, 2**40 + 5, -7])
def test_words_are_pythons(seed):
    made = random.Random(seed)
    assert next(P.words(seed))[:2000].tolist() == [made.getrandbits(32) for _ in range(2000)]


@pytest.mark.parametrize("n", [1, 2, 3, 8, 100, 1000])
def test_choices_are_pythons(n):
    made = random.Random(5)
    want = [made.choice(range(n)) for _ in range(3000)]
    for start, stop in ((0, 3000), (7, 8), (1234, 2500), (2999, 3000)):
        assert np.concatenate(list(P.choices(5, n, start, stop))).tolist() == want[start:stop]


def test_choices_across_blocks(monkeypatch):
    monkeypatch.setattr(P, "_WORDS", 64)
    made = random.Random(9)
    want = [made.choice(range(11)) for _ in range(700)]
    assert np.concatenate(list(P.choices(9, 11, 130, 700))).tolist() == want[130:]


@pytest.mark.parametrize(("n", "draws", "rule"), [(1, 50, "nearest"), (7, 1000, "nearest"), (40, 400, "lower"), (3, 1, "lower")])
def test_interval(spark, n, draws, rule):
    rng = random.Random(n)
    deltas = [(f"s{k:03}", rng.uniform(-0.2, 0.3)) for k in range(n)]
    means = replicates([d for _, d in deltas], draws, P.SEED)
    shuffled = spark.createDataFrame(rng.sample(deltas, n), "seed_id string, delta double")
    got = {r["replicate"]: r["mean"] for r in P.seeded_replicates(shuffled, draws, tasks=5).collect()}
    assert len(got) == draws and all(abs(got[k] - m) < 1e-12 for k, m in enumerate(means))
    low, high = P.seeded_interval(shuffled, draws, rule=rule).first()
    pick = (lambda q: percentile(means, q)) if rule == "nearest" else lambda q: sorted(means)[int(q * (draws - 1))]
    assert (low, high) == (pytest.approx(pick(0.025), abs=1e-6), pytest.approx(pick(0.975), abs=1e-6))


def test_no_deltas(spark):
    assert tuple(P.seeded_interval(spark.createDataFrame([], "seed_id long, delta double")).first()) == (0.0, 0.0)


def test_query_against_python(spark):
    row = precision_validation(spark, FOLDER).first()
    results, baseline = _parts(spark, FOLDER)
    deltas = [r["delta"] for r in P.seed_deltas(results, baseline).orderBy("seed_id").collect()]
    means = replicates(deltas, P.DRAWS, P.SEED)
    assert (row["low"], row["high"]) == (pytest.approx(percentile(means, 0.025), abs=1e-6), pytest.approx(percentile(means, 0.975), abs=1e-6))
    assert row["seeds"] == len(deltas) and row["decision"] == "NOT_PROMOTED" and "timeouts" in row["failed"] and row["faults"] == ""


RUN = {"status": "COMPLETED", "total": 0.9, "rebuilt": 0.9, "draft": 0.8, "revision": 0.9, "selector_evaluated": True, "selector_trace_valid": True, "selector_version": "v2", "contract_trace_valid": True, "repair_trace_valid": True, "contract_passed": True, "route_matched": True, "timeouts": 0, "violated": False}
SCHEMA = "seed_id string, status string, total double, rebuilt double, draft double, revision double, selector_evaluated boolean, selector_trace_valid boolean, selector_version string, contract_trace_valid boolean, repair_trace_valid boolean, contract_passed boolean, route_matched boolean, timeouts int, violated boolean"


def verdict(spark, change=None, gates=None, rows=None, baseline=0.8):
    runs = rows or [{"seed_id": s, **RUN} for s in "abc" for _ in range(2)]
    runs[0].update(change or {})
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    frame = spark.createDataFrame([tuple(r[k] for k in names) for r in runs], SCHEMA)
    base = spark.createDataFrame([(s, 0.8) for s in "abc"], "seed_id string, mean double")
    row = P.precision_validation(frame, base, baseline, 2, {"selector_version": "v2", **(gates or {})}, draws=200).first()
    return row["decision"], row["failed"], row["faults"]


def test_gates(spark):
    assert verdict(spark) == ("PRECISION_UPGRADE_VALIDATED", "", "")
    for change, failed in (
        ({"route_matched": False}, "route_mismatches"), ({"timeouts": 1}, "timeouts"), ({"violated": True}, "violations"), ({"draft": 0.95}, "regressive_selections"),
        ({"selector_trace_valid": None}, "selector_trace"), ({"selector_version": "v1"}, "selector_version"),
    ):
        assert verdict(spark, change) == ("NOT_PROMOTED", failed, "")
    # Gates that hold only where they are given.
    assert verdict(spark, {"contract_trace_valid": False, "repair_trace_valid": False, "contract_passed": False})[0] == "PRECISION_UPGRADE_VALIDATED"
    assert verdict(spark, {"contract_trace_valid": False, "repair_trace_valid": False, "contract_passed": False}, {"require_contract_trace": True, "require_repair_trace": True, "minimum_contract_pass_rate": 0.9})[1] == "contract_trace,repair_trace,contract_pass_rate"
    assert verdict(spark, gates={"minimum_average": 0.95}, baseline=0.99)[1] == "average,mean_delta"


def test_faults_refuse_a_verdict(spark):
    assert verdict(spark, {"status": "FAILED"})[::2] == ("REFUSED", "not_completed")
    assert verdict(spark, {"rebuilt": 0.8})[::2] == ("REFUSED", "reward_mismatch")
    assert verdict(spark, {"seed_id": "z"})[::2] == ("REFUSED", "unknown_seed,rounds")
