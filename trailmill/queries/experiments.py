"""An experiment over orders: arms by priority, some of whose runs are claimed twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmill.catalog import query
from trailmill.operators import experiments as X
from trailmill.sources.tables import table

_ARMS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")
_SQL = """runs AS (SELECT o_orderpriority AS arm, o_orderkey AS run_id FROM orders WHERE o_orderpriority < '5' UNION ALL SELECT '2-HIGH', o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 97 = 0),
facts AS (SELECT o_orderpriority AS arm, CAST(max(o_orderdate) AS DATE) AS d, count(*) AS n FROM orders WHERE o_orderpriority < '5' GROUP BY 1)"""


def _runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderpriority < '5'").select(F.col("o_orderpriority").alias("arm"), F.col("o_orderkey").alias("run_id"))
    return o.unionAll(o.where("arm = '1-URGENT' AND run_id % 97 = 0").withColumn("arm", F.lit("2-HIGH")))


def _arms(spark, sf_dir):
    """What an arm says of itself comes from its orders; two of them name one model, one has no job."""
    facts = table(spark, sf_dir, "orders").where("o_orderpriority < '5'").groupBy(F.col("o_orderpriority").alias("arm")).agg(F.to_date(F.max("o_orderdate")).cast("string").alias("d"), F.count("*").cast("string").alias("n"))
    digit = F.substring("arm", 1, 1)
    return facts.select(
        "arm", F.concat(F.lit("m-"), "d").alias("model_version"), F.when(digit == "3", "ACME").otherwise("acme").alias("provider"), F.when(digit == "4", F.lit("art-3")).otherwise(F.concat(F.lit("art-"), digit)).alias("artifact"),
        F.when(digit == "2", " ").otherwise(F.concat(F.lit("job-"), "n")).alias("job"), F.lit("prod").alias("deployment"), F.lit("v3").alias("reward_schema"), F.lit(None).cast("string").alias("checkpoint"),
        *[F.sha2(F.concat(F.lit(k), "n"), 256).alias(f"{k}_sha256") for k in ("config", "train", "validation")],
    )


@query("experiment_shared_runs", f"WITH {_SQL}, s AS (SELECT run_id, list_sort(list(DISTINCT arm)) AS arms FROM runs GROUP BY 1 HAVING len(list(DISTINCT arm)) > 1) SELECT arms[1] AS arm_a, arms[2] AS arm_b, count(*) AS n, min(run_id) AS example FROM s GROUP BY 1, 2")
def experiment_shared_runs(spark, sf_dir):
    return X.shared_runs(_runs(spark, sf_dir))


@query(
    "experiment_manifest",
    f"""WITH {_SQL}, a AS (SELECT arm, arm[1] AS g, n, CASE arm[1] WHEN '3' THEN 'ACME' ELSE 'acme' END AS provider, CASE arm[1] WHEN '4' THEN 'art-3' ELSE 'art-' || arm[1] END AS artifact, CASE arm[1] WHEN '2' THEN '' ELSE 'job-' || n END AS job FROM facts),
p AS (SELECT *, sha256('{{"artifact":"' || artifact || '","checkpoint":"","job":"' || job || '","provider":"' || provider || '"}}') AS model_fingerprint, sha256('{{"config_sha256":"' || sha256('config' || n) || '","reward_schema":"v3","train_sha256":"' || sha256('train' || n) || '","validation_sha256":"' || sha256('validation' || n) || '"}}') AS training_fingerprint FROM a),
h AS (SELECT DISTINCT arm, sha256(CAST(run_id AS VARCHAR)) AS h FROM runs), q AS (SELECT arm, h[1:3] AS g, sha256(string_agg(h, '' ORDER BY h)) AS h, count(*) AS n FROM h GROUP BY 1, 2), r AS (SELECT arm, CAST(sum(n) AS BIGINT) AS n_runs, sha256(string_agg(h, '' ORDER BY g)) AS runs_fingerprint FROM q GROUP BY 1),
s AS (SELECT count(*) AS n FROM (SELECT run_id FROM runs GROUP BY 1 HAVING count(DISTINCT arm) > 1)),
f AS (SELECT arm, array_to_string(list_sort(list_filter([CASE WHEN arm[1] = '2' THEN 'no job' END, CASE WHEN arm[1] IN ('3', '4') THEN 'shares its model: 3-MEDIUM 4-NOT SPECIFIED' END, CASE WHEN arm[1] = '1' AND s.n > 0 THEN 'shares runs with 2-HIGH: ' || s.n WHEN arm[1] = '2' AND s.n > 0 THEN 'shares runs with 1-URGENT: ' || s.n END], lambda x: x IS NOT NULL)), '; ') AS faults FROM facts, s)
SELECT arm, model_fingerprint, training_fingerprint, n_runs, runs_fingerprint, faults, faults = '' AS comparable FROM p JOIN r USING (arm) JOIN f USING (arm)""",
)
def experiment_manifest(spark, sf_dir):
    return X.manifest(_arms(spark, sf_dir), _runs(spark, sf_dir), _ARMS)
