"""Dataset export over orders: an order is a run, its customer's name spells the question."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmill.catalog import query
from trailmill.operators import readiness as E
from trailmill.plans.shared_store import Store
from trailmill.plans.views import stable_sql
from trailmill.sources.packages import read_package, write_package
from trailmill.sources.tables import table

_OPTIONS = E.ExportOptions(minimum_reward=0.3, validation_ratio=0.1, batch_size=64, profile="RLVR_RLAIF")
_POLICY = "p7"


def _runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    question = F.concat(F.when(k % 2 == 0, F.lit("  Order\tof ")).otherwise(F.lit("order  OF ")), F.lit("customer "), F.col("o_custkey").cast("string"))
    return o.select(
        k.alias("run_id"), F.when(F.col("o_orderstatus") == "P", "FAILED").otherwise("COMPLETED").alias("status"), F.when(k % 29 > 0, F.col("o_totalprice") / 500000).alias("reward"), F.when(k % 31 > 0, question).otherwise(F.lit(" \n\t")).alias("question"),
        F.when(k % 23 > 0, F.col("o_orderpriority")).when(k % 2 == 0, F.lit("\n ")).alias("answer"), F.when(k % 6 > 0, (k % 6).cast("int")).alias("rating"), F.when(k % 3 == 0, F.array(k)).otherwise(F.array().cast("array<long>")).alias("documents"),
    )


def _assessments(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").where(k % 8 < 6).select(k.alias("run_id"), (k % 5 < 3).alias("approved"), ((k % 11) / 10).alias("confidence"), ((k % 7) / 8).alias("agreement"))


_SQL = f"""WITH r AS (SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'P' THEN 'FAILED' ELSE 'COMPLETED' END AS status, CASE WHEN o_orderkey % 29 > 0 THEN o_totalprice / 500000 END AS reward,
  CASE WHEN o_orderkey % 31 > 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN '  Order' || chr(9) || 'of ' ELSE 'order  OF ' END || 'customer ' || o_custkey ELSE ' ' || chr(10) END AS question,
  CASE WHEN o_orderkey % 23 > 0 THEN o_orderpriority END AS answer, CASE WHEN o_orderkey % 6 > 0 THEN CAST(o_orderkey % 6 AS INTEGER) END AS rating FROM orders),
s AS (SELECT o_orderkey AS run_id, o_orderkey % 5 < 3 AS approved, (o_orderkey % 11) / 10.0::DOUBLE AS confidence, (o_orderkey % 7) / 8.0::DOUBLE AS agreement FROM orders WHERE o_orderkey % 8 < 6),
g AS (SELECT r.*, s.confidence, s.agreement, lower(trim(regexp_replace(question, '\\s+', ' ', 'g'))) AS q FROM r JOIN s USING (run_id) WHERE status = 'COMPLETED' AND reward >= 0.3::DOUBLE AND run_id % 31 > 0 AND answer IS NOT NULL AND approved AND confidence > 0),
b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY q ORDER BY reward DESC, run_id) = 1),
n AS (SELECT count(*) AS n FROM b),
e AS (SELECT b.*, n > 1 AND row_number() OVER (ORDER BY sha256(CAST(run_id AS VARCHAR)), run_id) <= greatest(1, least(n - 1, floor(n * 0.1::DOUBLE + 0.5))) AS validation FROM b, n)"""


@query(
    "dataset_readiness",
    f"""{_SQL}, t AS (SELECT count(*) FILTER (NOT validation) AS training, count(*) FILTER (validation) AS validation FROM e),
u AS (SELECT count(*) AS total, count(*) FILTER (rating >= 4) AS human_approved FROM r), v AS (SELECT count(*) FILTER (approved) AS automated_approved, {stable_sql("avg(confidence)", 4)} AS confidence, {stable_sql("avg(agreement)", 4)} AS agreement FROM s)
SELECT *, training + validation AS eligible, array_to_string(list_filter([CASE WHEN training + validation < total THEN 'excluded' END, CASE WHEN training + validation = 0 THEN 'none_eligible' END, CASE WHEN validation = 0 THEN 'validation_empty' END,
  CASE WHEN training <= 64 THEN 'training_within_batch' END, CASE WHEN training + validation < 50 THEN 'few_approved' END], lambda x: x IS NOT NULL), ',') AS warnings, training > 64 AND validation > 0 AS ready FROM t, u, v""",
)
def dataset_readiness(spark, sf_dir):
    runs, assessments = _runs(spark, sf_dir), _assessments(spark, sf_dir)
    return E.readiness(runs, assessments, E.eligible(runs, assessments, _OPTIONS), _OPTIONS)


@query(
    "dataset_package",
    f"""{_SQL} SELECT CASE WHEN validation THEN 'validation' ELSE 'train' END AS name, '{{"messages":[{{"role":"user","content":"' || replace(trim(question), chr(9), '\\t') || '"}}],"rollout_extra":{{"solution":"' || answer || '","source_trajectory_id":' || run_id || ',"source_policy_version":"{_POLICY}","source_reward_micro":' || CAST(floor(reward * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT)
  || ',"retrieved_document_ids":' || CASE WHEN run_id % 3 = 0 THEN '[' || run_id || ']' ELSE '[]' END || CASE WHEN rating IS NOT NULL THEN ',"human_rating":' || rating ELSE '' END || ',"verification_contract":{{"minimum_answer_chars":80,"maximum_answer_chars":6000,"citation_required":' || CASE WHEN run_id % 3 = 0 THEN 'true' ELSE 'false' END
  || '}},"alignment_confidence_micro":' || CAST(floor(confidence * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT) || ',"judge_agreement_micro":' || CAST(floor(agreement * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT) || '}}}}' AS value FROM e""",
)
def dataset_package(spark, sf_dir):
    """Written as a package and read again through its manifest."""
    store, assessments = Store(spark, "package"), _assessments(spark, sf_dir)
    lines = store.put(E.sample_lines(E.eligible(_runs(spark, sf_dir), assessments, _OPTIONS), assessments, _POLICY))
    folder = f"{store.root}/package"
    write_package({"train": lines.where("NOT validation"), "validation": lines.where("validation")}, folder, {"policy": _POLICY, "profile": _OPTIONS.profile})
    tables, _ = read_package(spark, folder)
    return tables["train"].select(F.lit("train").alias("name"), "value").unionAll(tables["validation"].select(F.lit("validation").alias("name"), "value"))
