"""Agent-run views over the driver's tables, for queries and tests. Real runs come from ``sources.runs``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.sources.tables import table

SINGLE, MULTI = "SINGLE_AGENT", "ADAPTIVE_MULTI_AGENT"


def routing_key():
    return F.concat(F.lit("run-"), F.col("run_id").cast("string"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order as a run. Costs are null where a run has no line (not measured)."""
    orders, customer, lines = (table(spark, sf_dir, t) for t in ("orders", "customer", "lineitem"))
    used = lines.groupBy(F.col("l_orderkey").alias("run_id")).agg((F.sum(F.col("l_quantity").cast("long")) * 100).alias("latency_ms"), (F.sum(F.floor(F.col("l_extendedprice") * 100 + 0.5)) / 1e9).alias("cost"))
    base = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_custkey").alias("sample_id"),
        F.col("c_mktsegment").alias("bucket"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), MULTI).otherwise(SINGLE).alias("mode"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "FAILED").otherwise("CANCELLED").alias("status"),
        F.col("o_orderdate").alias("completed_at"),
        (F.col("o_totalprice") / 500000).alias("reward"),
        F.when(F.col("o_orderkey") % 3 == 0, 1.0).when(F.col("o_orderkey") % 3 == 1, 0.7).otherwise(0.0).alias("grounding"),
    )
    return base.join(used, "run_id", "left").withColumn("latency_ms", F.coalesce("latency_ms", F.lit(0).cast("long")))


#: The same view in SQL, to stand first in a query's WITH list.
RUNS_SQL = """runs AS (
  SELECT o_orderkey AS run_id, o_custkey AS sample_id, c_mktsegment AS bucket, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'ADAPTIVE_MULTI_AGENT' ELSE 'SINGLE_AGENT' END AS mode,
    CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'FAILED' ELSE 'CANCELLED' END AS status, o_orderdate AS completed_at, o_totalprice / 500000 AS reward,
    CASE o_orderkey % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS grounding, cost, coalesce(latency_ms, 0) AS latency_ms
  FROM orders JOIN customer ON o_custkey = c_custkey
  LEFT JOIN (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) * 100 AS BIGINT) AS latency_ms, sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) / 1e9::DOUBLE AS cost FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""

FRACTION_SQL = "(list_reduce(list_prepend(0::BIGINT, list_transform(string_split('run-' || CAST(run_id AS VARCHAR), ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) / 4294967296.0::DOUBLE)"


def jround_sql(value: str, digits: int = 8) -> str:
    return f"(floor(({value}) * 1e{digits}::DOUBLE + 0.5::DOUBLE) / 1e{digits}::DOUBLE)"


def stable_sql(value: str, digits: int) -> str:
    return jround_sql(jround_sql(value, 10), digits)
