"""Packages that are whole or refused; who may train, and whether it is enough."""

import hashlib

import pytest
from pyspark.sql import functions as F

from trailmill.operators import readiness as E
from trailmill.plans.shared_store import Store, removed
from trailmill.sources.packages import BrokenPackage, read_package, write_package


def package(spark):
    folder = f"{Store(spark, 't').root}/package"
    line = lambda n, tag: spark.range(n).select(F.concat(F.lit(tag), F.col("id").cast("string")).alias("value"), F.lit(1).alias("more"))
    write_package({"train": line(50, "t").repartition(3), "validation": line(0, "v")}, folder, {"policy": "p1", "n": 50}, lines_a_file=10)
    return folder


def files(spark, folder, name):
    return sorted(r[0] for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/{name}").select("path").collect())


def test_round_trip(spark):
    folder = package(spark)
    tables, facts = read_package(spark, folder)
    assert facts == {"policy": "p1", "n": 50} and sorted(tables) == ["train", "validation"]
    assert {r[0] for r in tables["train"].collect()} == {f"t{k}" for k in range(50)} and tables["validation"].count() == 0
    assert len(files(spark, folder, "train")) >= 5
    with pytest.raises(FileExistsError):
        write_package({"train": spark.range(1).selectExpr("'x' AS value")}, folder, {})


def test_half_written_is_refused_and_written_anew(spark):
    folder = package(spark)
    removed(spark, f"{folder}/manifest/_SUCCESS")
    with pytest.raises(BrokenPackage, match="no whole manifest"):
        read_package(spark, folder)
    write_package({"train": spark.createDataFrame([("new",)], "value string")}, folder, {})
    tables, _ = read_package(spark, folder)
    assert [r[0] for r in tables["train"].collect()] == ["new"]


@pytest.mark.parametrize("harm", ["file", "table", "added", "changed", "list"])
def test_changed_packages_are_refused(spark, harm):
    folder = package(spark)
    if harm == "file":
        removed(spark, files(spark, folder, "train")[0])
    elif harm == "table":
        removed(spark, f"{folder}/train")
    elif harm == "added":
        spark.createDataFrame([("extra",)], "value string").write.mode("append").text(f"{folder}/train")
    elif harm == "changed":
        path = files(spark, folder, "train")[0].removeprefix("file:")
        with open(path, "r+b") as f:
            f.write(b"T")
        removed(spark, path.rsplit("/", 1)[0] + "/." + path.rsplit("/", 1)[1] + ".crc")
    else:
        line = spark.createDataFrame([('{"name":"train","file":"part-x","bytes":1,"sha256":"00"}',)], "value string")
        line.write.mode("append").text(f"{folder}/manifest")
    with pytest.raises(BrokenPackage, match={"list": "list of files", "table": "no table train"}.get(harm, "not as in the manifest")):
        read_package(spark, folder)


RUNS = "run_id string, status string, reward double, question string, answer string, rating int"
JUDGED = "run_id string, approved boolean, confidence double, agreement double"


def chosen(spark, runs, judged, profile="RLVR_RLAIF", picked=None, ratio=0.3, batch=64):
    options = E.ExportOptions(0.5, ratio, batch, profile)
    r, j = spark.createDataFrame(runs, RUNS), spark.createDataFrame(judged, JUDGED)
    got = E.eligible(r, j, options, None if picked is None else spark.createDataFrame([(p,) for p in picked], "question string"))
    return {x["run_id"]: x["validation"] for x in got.collect()}, E.readiness(r, j, got, options).first()


RUN = [
    ("a", "COMPLETED", 0.9, "How  so?", "yes", None), ("b", "COMPLETED", 0.9, " how so? ", "no", 5), ("c", "COMPLETED", 0.95, "HOW\tSO?", "\n　", 5), ("d", "FAILED", 0.9, "q2", "x", 5),
    ("e", "COMPLETED", 0.4, "q3", "x", 5), ("f", "COMPLETED", None, "q4", "x", 4), ("g", "COMPLETED", 0.5, "q5", "x", 4), ("h", "COMPLETED", 0.8, "\n", "x", 4), ("i", "COMPLETED", 0.8, "q6", "x", 3),
]
JUDGE = [("a", True, 0.8, 0.5), ("b", True, 0.7, 1.0), ("g", True, 0.0, 1.0), ("i", True, 0.9, 1.0), ("e", False, 0.9, None)]


def test_profiles(spark):
    assert set(chosen(spark, RUN, JUDGE)[0]) == {"a", "i"}
    assert set(chosen(spark, RUN, JUDGE, "HUMAN_APPROVED")[0]) == {"b", "g"}
    assert set(chosen(spark, RUN, JUDGE, "RLVR_ONLY")[0]) == {"a", "g", "i"}
    # A question that a person approved counts as chosen.
    assert set(chosen(spark, RUN, JUDGE, "FULL_TRAJECTORY_GUIDED", [])[0]) == {"a"}
    assert set(chosen(spark, RUN, JUDGE, "FULL_TRAJECTORY_GUIDED", ["q6"])[0]) == {"a", "i"}
    with pytest.raises(ValueError):
        chosen(spark, RUN, JUDGE, "FULL_TRAJECTORY_GUIDED")


def test_split_and_readiness(spark):
    runs = [(f"r{k}", "COMPLETED", 0.9, f"q{k}", "x", None) for k in range(11)]
    got, row = chosen(spark, runs, [], "RLVR_ONLY", batch=7)
    order = sorted(got, key=lambda k: hashlib.sha256(k.encode()).hexdigest())
    assert [got[k] for k in order] == [True] * 3 + [False] * 8
    assert (row["total"], row["eligible"], row["training"], row["validation"], row["ready"], row["warnings"]) == (11, 11, 8, 3, True, "few_approved")
    assert not chosen(spark, runs, [], "RLVR_ONLY", batch=8)[1]["ready"]


@pytest.mark.parametrize(("n", "validation", "warnings"), [(0, 0, "none_eligible,validation_empty,training_within_batch,few_human_approved"), (1, 0, "validation_empty,training_within_batch,few_human_approved"), (2, 1, "training_within_batch,few_human_approved")])
def test_few_runs(spark, n, validation, warnings):
    got, row = chosen(spark, [(f"r{k}", "COMPLETED", 0.9, f"q{k}", "x", 5) for k in range(n)], [], "HUMAN_APPROVED")
    assert sum(got.values()) == validation == row["validation"] and row["warnings"] == warnings and not row["ready"]


def test_options_are_checked():
    for bad in ({"minimum_reward": 1.1}, {"validation_ratio": 0.0}, {"validation_ratio": 0.6}, {"batch_size": 0}, {"profile": "ANY"}):
        with pytest.raises(ValueError):
            E.ExportOptions(**bad)
