"""Which runs become training samples, how they are split, and whether that is enough to train on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.functions.numeric import stable
from trailmill.functions.text import normalised, says, stripped
from trailmill.operators.datasets import best_per, hash_split

#: Who has to have approved a run: a person, nobody, the judges, or the judges and the selection by reward course.
PROFILES = ("HUMAN_APPROVED", "RLVR_ONLY", "RLVR_RLAIF", "FULL_TRAJECTORY_GUIDED")
#: Stars from which a person's rating approves; fewer eligible runs than this call for a warning.
APPROVING_STARS, FEW = 4, 50


@dataclass(frozen=True)
class ExportOptions:
    minimum_reward: float = 0.5
    validation_ratio: float = 0.1
    batch_size: int = 64
    profile: str = "RLVR_RLAIF"

    def __post_init__(self):
        if not 0 <= self.minimum_reward <= 1:
            raise ValueError("minimum_reward must be between 0 and 1")
        if not 0 < self.validation_ratio <= 0.5:
            raise ValueError("validation_ratio must be above 0 and at most 0.5")
        if self.batch_size < 1:
            raise ValueError("batch_size must be positive")
        if self.profile not in PROFILES:
            raise ValueError(f"profile must be one of {', '.join(PROFILES)}")


def eligible(runs: DataFrame, assessments: DataFrame, options: ExportOptions, chosen: DataFrame | None = None) -> DataFrame:
    """Runs that may train, the best one a question, with ``validation``. runs: run_id, status, reward, question, answer, rating. assessments:
    run_id, approved, confidence, agreement (one a run). chosen: question (normal form), what the reward courses selected, for
    FULL_TRAJECTORY_GUIDED; a question that a person approved is chosen too. A single run trains."""
    human = F.coalesce(F.col("rating") >= APPROVING_STARS, F.lit(False))
    rows = runs.withColumn("sample", normalised(F.coalesce("question", F.lit(""))))
    good = rows.where((F.col("status") == "COMPLETED") & F.coalesce(F.col("reward") >= options.minimum_reward, F.lit(False)) & says(F.col("question")) & says(F.col("answer")))
    if options.profile == "HUMAN_APPROVED":
        good = good.where(human)
    elif options.profile != "RLVR_ONLY":
        good = good.join(assessments.where("approved AND confidence > 0").select("run_id"), "run_id", "left_semi")
    if options.profile == "FULL_TRAJECTORY_GUIDED":
        if chosen is None:
            raise ValueError("FULL_TRAJECTORY_GUIDED needs the chosen questions")
        good = good.join(chosen.select(F.col("question").alias("sample")).unionByName(rows.where(human).select("sample")).distinct(), "sample", "left_semi")
    best = best_per(good, "sample", F.desc("reward"), F.asc("run_id")).drop("sample")
    split = hash_split(best, "run_id", options.validation_ratio)
    several = best.select("run_id").limit(2).groupBy().agg((F.count("*") > 1).alias("_several"))
    return split.join(F.broadcast(several), F.lit(True), "left").withColumn("validation", F.col("validation") & F.col("_several")).drop("_several")  # one row


def readiness(runs: DataFrame, assessments: DataFrame, chosen_runs: DataFrame, options: ExportOptions) -> DataFrame:
    """One row: counts, averages over all assessments, warnings (joined by commas) and ``ready``: more training runs than a batch, and a
    validation run. chosen_runs: what ``eligible`` gave."""
    a = runs.agg(F.count("*").alias("total"), F.count_if(F.col("rating") >= APPROVING_STARS).alias("human_approved"))
    b = assessments.agg(F.count_if("approved").alias("automated_approved"), stable(F.coalesce(F.avg("confidence"), F.lit(0.0)), 4).alias("confidence"), stable(F.coalesce(F.avg("agreement"), F.lit(0.0)), 4).alias("agreement"))
    c = chosen_runs.agg(F.count_if(~F.col("validation")).alias("training"), F.count_if("validation").alias("validation"))
    one = a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c)).withColumn("eligible", F.col("training") + F.col("validation"))  # one row each
    few = "few_human_approved" if options.profile == "HUMAN_APPROVED" else "few_approved"
    warnings = {
        "excluded": F.col("eligible") < F.col("total"),
        "none_eligible": (F.col("eligible") == 0) & F.lit(options.profile != "RLVR_ONLY"),
        "validation_empty": F.col("validation") == 0,
        "training_within_batch": F.col("training") <= options.batch_size,
        few: F.col("eligible") < FEW,
    }
    out = one.withColumn("warnings", F.array_join(F.array_compact(F.array(*[F.when(is_so, name) for name, is_so in warnings.items()])), ","))
    return out.withColumn("ready", (F.col("training") > options.batch_size) & (F.col("validation") > 0))


def sample_lines(rows: DataFrame, assessments: DataFrame, policy: str) -> DataFrame:
    """``validation`` and ``value``: each run as a training sample in JSON, with what is known of it. rows: what ``eligible`` gave, with documents
    (array of ids)."""
    micro = lambda c: F.floor(F.col(c) * 1e6 + 0.5)
    told = rows.join(assessments.withColumnRenamed("agreement", "_agreement").withColumnRenamed("confidence", "_confidence"), "run_id", "left")
    contract = F.struct(F.lit(80).alias("minimum_answer_chars"), F.lit(6000).alias("maximum_answer_chars"), (F.size("documents") > 0).alias("citation_required"))
    extra = F.struct(
        F.col("answer").alias("solution"), F.col("run_id").alias("source_trajectory_id"), F.lit(policy).alias("source_policy_version"), micro("reward").alias("source_reward_micro"), F.col("documents").alias("retrieved_document_ids"),
        F.col("rating").alias("human_rating"), contract.alias("verification_contract"), micro("_confidence").alias("alignment_confidence_micro"), micro("_agreement").alias("judge_agreement_micro"),
    )
    messages = F.array(F.struct(F.lit("user").alias("role"), stripped(F.col("question")).alias("content")))
    return told.select("validation", F.to_json(F.struct(messages.alias("messages"), extra.alias("rollout_extra"))).alias("value"))
