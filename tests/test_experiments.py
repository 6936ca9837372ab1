"""Arms that share nothing may be compared; each fault is named with the arms it concerns."""

import hashlib
import json

from trailmill.operators import experiments as X

NAMES = ["arm", "checkpoint", *X.REQUIRED]
FINE = {"checkpoint": None, "provider": "acme", "job": "j", "deployment": "prod", "reward_schema": "v3", "model_version": "m1", "config_sha256": "c", "train_sha256": "t", "validation_sha256": "v"}
EXPECTED = ("a", "b")


def arms(spark, *rows):
    return spark.createDataFrame([tuple({**FINE, "artifact": f"art-{r['arm']}", **r}[k] for k in NAMES) for r in rows], ", ".join(f"{k} string" for k in NAMES))


def runs(spark, **claimed):
    return spark.createDataFrame([(arm, r) for arm, ids in claimed.items() for r in ids], "arm string, run_id long")


def checked(spark, frame, claimed):
    return {r.arm: (r.comparable, r.faults, r.n_runs) for r in X.manifest(frame, claimed, EXPECTED).collect()}


def test_arms_that_share_nothing(spark):
    got = X.manifest(arms(spark, {"arm": "a"}, {"arm": "b", "checkpoint": "k"}), runs(spark, a=[1, 2, 2], b=[3]), EXPECTED).orderBy("arm").collect()
    assert [(r.comparable, r.faults, r.n_runs) for r in got] == [(True, "", 2), (True, "", 1)]
    told = json.dumps({"provider": "acme", "artifact": "art-b", "job": "j", "checkpoint": "k"}, sort_keys=True, separators=(",", ":"))
    assert got[1].model_fingerprint == hashlib.sha256(told.encode()).hexdigest()
    other = X.manifest(arms(spark, {"arm": "a"}, {"arm": "b"}), runs(spark, a=[2, 1], b=[4]), EXPECTED).orderBy("arm").collect()
    assert other[0].runs_fingerprint == got[0].runs_fingerprint and other[1].runs_fingerprint != got[1].runs_fingerprint
    assert other[1].model_fingerprint != got[1].model_fingerprint and other[1].training_fingerprint == got[1].training_fingerprint


def test_shared_runs_name_the_pair(spark):
    claimed = runs(spark, a=[1, 2, 3], b=[3, 4, 2], c=[2])
    assert {tuple(r) for r in X.shared_runs(claimed).collect()} == {("a", "b", 2, 2), ("a", "c", 1, 2), ("b", "c", 1, 2)}
    got = checked(spark, arms(spark, {"arm": "a"}, {"arm": "b"}), runs(spark, a=[1, 2], b=[2]))
    assert got == {"a": (False, "shares runs with b: 1", 2), "b": (False, "shares runs with a: 1", 1)}


def test_shared_models_and_blank_fields(spark):
    got = checked(spark, arms(spark, {"arm": "a", "artifact": " x ", "provider": "ACME"}, {"arm": "b", "artifact": "x", "job": "<job id>", "deployment": None}), runs(spark, a=[1], b=[2]))
    assert got["a"][1] == "shares its model: a b" and got["b"][1] == "no deployment; no job; shares its model: a b"


def test_missing_unknown_repeated_and_empty(spark):
    got = checked(spark, arms(spark, {"arm": "a"}, {"arm": "a", "artifact": "y"}, {"arm": "z"}), runs(spark, a=[1]))
    assert got == {"a": (False, "repeated", 1), "b": (False, "missing", 0), "z": (False, "unknown", 0)}
    assert checked(spark, arms(spark, {"arm": "a"}, {"arm": "b"}), runs(spark, a=[1])) == {"a": (True, "", 1), "b": (False, "", 0)}
