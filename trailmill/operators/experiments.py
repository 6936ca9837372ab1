"""Experiment manifests: arms that can be compared, because none shares a model, a name or a run with another.

The arms are a handful; the runs are not. One aggregate over the runs finds those that more than one arm claims, and one more
gives each arm a fingerprint of its runs as a set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmill.functions.text import says, stripped

#: What an arm has to say; checkpoint may be empty.
REQUIRED = ("model_version", "provider", "artifact", "job", "deployment", "reward_schema", "config_sha256", "train_sha256", "validation_sha256")
PLACEHOLDER = r"(?i)^\s*$|replace|todo|<[^>]*>|^(tbd|none|null|n/a)$"


def _canonical(**values: Column) -> Column:
    """SHA-256 of a JSON object with its keys in order and nothing between its parts."""
    return F.sha2(F.to_json(F.struct(*[F.coalesce(values[k], F.lit("")).alias(k) for k in sorted(values)])), 256)


def fingerprinted(arms: DataFrame) -> DataFrame:
    """Adds model_fingerprint (provider, artifact, job, checkpoint) and training_fingerprint (reward schema and evidence). arms: arm, checkpoint and
    ``REQUIRED``."""
    c = {name: stripped(F.col(name)) for name in (*REQUIRED, "checkpoint")}
    model = _canonical(**{k: c[k] for k in ("provider", "artifact", "job", "checkpoint")})
    training = _canonical(**{k: c[k] for k in ("reward_schema", "config_sha256", "train_sha256", "validation_sha256")})
    return arms.withColumns({"model_fingerprint": model, "training_fingerprint": training})


def arm_faults(arms: DataFrame, expected: tuple[str, ...]) -> DataFrame:
    """(arm, fault): missing, unknown and repeated arms, fields without a real value, and models that two arms share (both are named)."""
    spark = arms.sparkSession
    names = spark.createDataFrame([(a,) for a in expected], "arm string")
    counted = names.join(arms.groupBy("arm").agg(F.count("*").alias("n")), "arm", "full_outer").join(names.withColumn("known", F.lit(True)), "arm", "left")
    wrong = F.when(F.col("n").isNull(), "missing").when(F.col("known").isNull(), "unknown").when(F.col("n") > 1, "repeated")
    named = counted.withColumn("fault", wrong).where("fault IS NOT NULL").select("arm", "fault")
    real = lambda name: says(F.col(name)) & ~F.coalesce(F.col(name).rlike(PLACEHOLDER), F.lit(True))
    blank = arms.select("arm", F.explode(F.array_compact(F.array(*[F.when(~real(c), f"no {c}") for c in REQUIRED]))).alias("fault"))
    models = arms.groupBy(F.lower(stripped(F.col("provider"))).alias("p"), stripped(F.col("artifact")).alias("a")).agg(F.sort_array(F.collect_set("arm")).alias("arms")).where(F.size("arms") > 1)
    shared = models.select(F.explode("arms").alias("arm"), F.concat(F.lit("shares its model: "), F.array_join("arms", " ")).alias("fault"))
    return named.unionByName(blank).unionByName(shared)


def shared_runs(runs: DataFrame) -> DataFrame:
    """(arm_a, arm_b, n, example): the pairs of arms that claim the same runs, how many, and the first of them. runs: arm, run_id."""
    several = runs.groupBy("run_id").agg(F.sort_array(F.collect_set("arm")).alias("arms")).where(F.size("arms") > 1)
    first = several.select("run_id", "arms", F.posexplode("arms").alias("i", "arm_a"))
    pairs = first.select("run_id", "arm_a", F.explode(F.slice("arms", F.col("i") + 2, F.size("arms"))).alias("arm_b"))
    return pairs.groupBy("arm_a", "arm_b").agg(F.count("*").alias("n"), F.min("run_id").alias("example"))


def run_sets(runs: DataFrame) -> DataFrame:
    """arm, n_runs, runs_fingerprint: of each arm's different runs, whatever their order. The digests of 4096 groups are hashed once more."""
    one = runs.select("arm", F.sha2(F.col("run_id").cast("string"), 256).alias("h")).distinct()
    groups = one.groupBy("arm", F.substring("h", 1, 3).alias("g")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"), F.count("*").alias("n"))
    return groups.groupBy("arm").agg(F.sum("n").alias("n_runs"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), ""), 256).alias("runs_fingerprint"))


def manifest(arms: DataFrame, runs: DataFrame, expected: tuple[str, ...]) -> DataFrame:
    """One row an arm: fingerprints, runs, its faults (joined by "; ", those of shared runs among them) and whether it may be compared. An arm
    may be compared if it has no fault and at least one run."""
    told = arm_faults(arms, expected)
    pairs = shared_runs(runs)
    both = pairs.select(F.col("arm_a").alias("arm"), F.col("arm_b").alias("other"), "n").unionAll(pairs.select("arm_b", "arm_a", "n"))
    told = told.unionAll(both.select("arm", F.concat(F.lit("shares runs with "), "other", F.lit(": "), F.col("n").cast("string"))))
    faults = told.groupBy("arm").agg(F.array_join(F.sort_array(F.collect_set("fault")), "; ").alias("faults"))
    prints = fingerprinted(arms).groupBy("arm").agg(F.min("model_fingerprint").alias("model_fingerprint"), F.min("training_fingerprint").alias("training_fingerprint"))
    out = prints.join(run_sets(runs), "arm", "full_outer").join(faults, "arm", "full_outer")
    out = out.withColumns({"faults": F.coalesce("faults", F.lit("")), "n_runs": F.coalesce("n_runs", F.lit(0))})
    return out.withColumn("comparable", (F.col("faults") == "") & (F.col("n_runs") > 0))
