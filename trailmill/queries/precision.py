"""Precision validation over orders: a customer is a seed, its first two orders are the candidate's rounds, all others the frozen runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trailmill.catalog import query
from trailmill.operators import precision as P
from trailmill.plans.views import jround_sql as R
from trailmill.sources.tables import table

_VERSION = "v2"
_MODEL = {
    "total": "o_totalprice / 500000",
    "draft": "CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice / 500000 + (o_orderkey % 5 - 4) / 100.0D END",
    "revision": "CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 500000 + (o_orderkey % 23 - 22) / 100.0D END",
    "selector_evaluated": "o_orderkey % 3 > 0",
    "selector_trace_valid": "o_orderkey % 101 > 0",
    "selector_version": "CASE WHEN o_orderkey % 211 > 0 THEN 'v2' ELSE 'v1' END",
    "contract_trace_valid": "o_orderkey % 50 > 0",
    "repair_trace_valid": "o_orderkey % 60 > 0",
    "contract_passed": "o_orderkey % 10 > 0",
    "route_matched": "o_orderstatus <> 'P'",
    "violated": "o_orderpriority = '5-LOW' AND o_orderkey % 4 = 0",
}


def _parts(spark, sf_dir):
    """(results, baseline): customers with three orders at least."""
    place = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = table(spark, sf_dir, "orders").withColumn("round", F.row_number().over(place)).withColumn("_n", F.count("*").over(Window.partitionBy("o_custkey"))).where("_n > 2")
    results = orders.where("round <= 2").select(F.col("o_custkey").alias("seed_id"), "round", F.lit("COMPLETED").alias("status"), *[F.expr(v).alias(k) for k, v in _MODEL.items()], F.expr(_MODEL["total"]).alias("rebuilt"), (F.col("o_orderkey") % 17 == 0).cast("int").alias("timeouts"))
    return results, orders.where("round > 2").groupBy(F.col("o_custkey").alias("seed_id")).agg(F.avg(F.col("o_totalprice") / 500000).alias("mean"))


_SQL = f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS round, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders QUALIFY n > 2),
r AS (SELECT o_custkey AS seed_id, o_orderkey, {', '.join(f'{v.replace("100.0D", "100.0::DOUBLE")} AS {k}' for k, v in _MODEL.items())} FROM o WHERE round <= 2),
b AS (SELECT o_custkey AS seed_id, avg(o_totalprice / 500000) AS mean FROM o WHERE round > 2 GROUP BY 1)"""


@query(
    "precision_deltas",
    f"{_SQL} SELECT seed_id, count(*) AS n, {R('avg(total)', 6)} AS candidate, {R('avg(total) - max(mean)', 6)} AS delta FROM r JOIN b USING (seed_id) GROUP BY 1",
)
def precision_deltas(spark, sf_dir):
    from trailmill.functions.numeric import jround

    out = P.seed_deltas(*_parts(spark, sf_dir))
    return out.select("seed_id", "n", jround("candidate", 6).alias("candidate"), jround("delta", 6).alias("delta"))


@query(
    "precision_metrics",
    f"""{_SQL} SELECT count(*) AS runs, count(*) FILTER (NOT route_matched) AS route_mismatches, count(*) FILTER (o_orderkey % 17 = 0) AS timeouts, count(*) FILTER (violated) AS violations, count(*) FILTER (selector_evaluated) AS selector_evaluated,
count(*) FILTER (selector_evaluated AND total + 1e-9::DOUBLE < coalesce(greatest(draft, revision), draft, revision)) AS regressive_selections, count(*) FILTER (selector_evaluated AND NOT selector_trace_valid) AS invalid_selector_traces,
count(*) FILTER (selector_evaluated AND selector_version <> 'v2') AS invalid_selector_versions, count(*) FILTER (contract_trace_valid) AS contract_traces, count(*) FILTER (repair_trace_valid) AS repair_traces, count(*) FILTER (contract_passed) AS contract_passed,
count(DISTINCT seed_id) AS seeds, {R('avg(total)', 6)} AS candidate_average, {R('avg(total) - 0.5::DOUBLE', 6)} AS mean_delta, {R('count(*) FILTER (contract_passed) / count(*)', 6)} AS contract_pass_rate, '' AS faults FROM r""",
)
def precision_metrics(spark, sf_dir):
    return P.precision_metrics(*_parts(spark, sf_dir), 0.5, 2, _VERSION)


@query("precision_validation")
def precision_validation(spark, sf_dir):
    """No SQL: the draws are those of Python's generator. tests/test_precision.py holds it against that generator."""
    return P.precision_validation(*_parts(spark, sf_dir), 0.5, 2, {"selector_version": _VERSION, "minimum_contract_pass_rate": 0.8})
