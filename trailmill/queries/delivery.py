"""Gates, delivery and registry queries over the run view."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmill.catalog import query
from trailmill.operators import delivery as V
from trailmill.plans.views import RUNS_SQL, runs
from trailmill.plans.views import jround_sql as R
from trailmill.plans.views import stable_sql as S
from trailmill.sources.tables import table


def _replays(spark, sf_dir):
    k = F.col("run_id")
    expected = F.when(k % 6 == 0, None).when(F.col("bucket") == "BUILDING", "ADAPTIVE_MULTI_AGENT").otherwise(F.col("mode"))
    return runs(spark, sf_dir).select(F.col("sample_id").alias("seed_id"), "status", (F.col("grounding") > 0).alias("gate"), "reward", (k % 3).alias("n_violations"), expected.alias("expected_mode"), "mode", F.when(k % 97 == 0, 1).otherwise(0).alias("timeouts"))


_REPLAYS = f"""{RUNS_SQL}, rp AS (SELECT sample_id AS seed_id, status, grounding > 0 AS gate, reward, run_id % 3 AS nv, CASE WHEN run_id % 6 = 0 THEN NULL WHEN bucket = 'BUILDING' THEN 'ADAPTIVE_MULTI_AGENT' ELSE mode END AS em, mode, CASE WHEN run_id % 97 = 0 THEN 1 ELSE 0 END AS tm FROM runs),
sd AS (SELECT seed_id, list_filter([CASE WHEN count(*) <> 10 THEN 'rounds' END, CASE WHEN NOT bool_and(status = 'COMPLETED') THEN 'incomplete' END, CASE WHEN NOT bool_and(gate) THEN 'hard_gate' END, CASE WHEN min(reward) < 0.1::DOUBLE THEN 'reward' END, CASE WHEN sum(tm) > 0 THEN 'timeout' END], lambda x: x IS NOT NULL) AS reasons FROM rp GROUP BY 1)"""


def _fails(names):
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT {n} THEN '{n}' END" for n in names) + "], lambda x: x IS NOT NULL), ',')"


_SEVEN = ("all_runs_completed", "all_gates_passed", "average_met", "violations_within_limit", "routes_evaluated", "mismatches_within_limit", "timeouts_within_limit")


@query(
    "replay_gate",
    f"""WITH {_REPLAYS}, a AS (SELECT count(*) AS planned, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (gate) AS gated, {S("avg(reward)", 6)} AS average, CAST(sum(nv) AS BIGINT) AS violations, count(em) AS expected, count(*) FILTER (em <> mode) AS mismatches, CAST(sum(tm) AS BIGINT) AS timeouts FROM rp),
c AS (SELECT *, planned = completed AS all_runs_completed, gated = planned AS all_gates_passed, average >= 0.2::DOUBLE AS average_met, violations <= 100 AS violations_within_limit, true AS routes_evaluated, mismatches <= 1000000 AS mismatches_within_limit, timeouts <= 5 AS timeouts_within_limit FROM a)
SELECT planned, completed, average, violations, mismatches, timeouts, {", ".join(_SEVEN)}, {_fails(_SEVEN)} AS failures, {_fails(_SEVEN)} = '' AS passed FROM c""",
)
def replay_gate(spark, sf_dir):
    return V.replay_gate(_replays(spark, sf_dir), 0.2, 1_000_000, 5, 100)


@query("seed_reasons", f"WITH {_REPLAYS} SELECT seed_id, array_to_string(reasons, ',') AS reasons FROM sd")
def seed_reasons(spark, sf_dir):
    return V.seed_reasons(_replays(spark, sf_dir), 10, 0.1).withColumn("reasons", F.array_join("reasons", ","))


_THREE = ("all_runs_completed", "all_seeds_evaluated", "enough_seeds")


@query(
    "collection_gate",
    f"""WITH {_REPLAYS}, c AS (SELECT a.*, b.*, planned = completed AS all_runs_completed, expected = evaluated AS all_seeds_evaluated, qualified >= 1 AS enough_seeds FROM (SELECT count(*) AS planned, count(*) FILTER (status = 'COMPLETED') AS completed, count(DISTINCT seed_id) AS expected FROM rp) a, (SELECT count(*) AS evaluated, count(*) FILTER (len(reasons) = 0) AS qualified FROM sd) b)
SELECT planned, completed, evaluated, qualified, {", ".join(_THREE)}, {_fails(_THREE)} AS failures, {_fails(_THREE)} = '' AS passed FROM c""",
)
def collection_gate(spark, sf_dir):
    base = _replays(spark, sf_dir)
    return V.collection_gate(base, V.seed_reasons(base, 10, 0.1), 1)


@query(
    "progressive_delivery",
    """WITH d AS (SELECT s_suppkey AS id, ['OFF', 'SHADOW', 'CANARY', 'CANARY', 'ACTIVE'][s_suppkey % 5 + 1] AS mode, (CAST([0.0, 0.05, 0.1, 0.25, 0.5] AS DOUBLE[]))[s_suppkey % 7 % 5 + 1] AS rate, s_suppkey % 4 <> 0 AS cool, s_suppkey % 3 <> 0 AS trained, s_suppkey % 2 = 0 AS validated, ['HEALTHY', 'HEALTHY', 'COLLECTING', 'VIOLATED'][s_suppkey % 11 % 4 + 1] AS guard, ['READY', 'COLLECTING', 'REGRESSION'][s_suppkey % 13 % 3 + 1] AS ope FROM supplier),
t AS (SELECT *, CASE WHEN mode IN ('OFF', 'SHADOW') THEN 0.05::DOUBLE WHEN mode = 'ACTIVE' OR rate >= 0.5 THEN 1.0::DOUBLE WHEN rate < 0.05 THEN 0.05::DOUBLE WHEN rate < 0.1 THEN 0.1::DOUBLE WHEN rate < 0.25 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS target_rate FROM d),
b AS (SELECT *, list_filter([CASE WHEN NOT cool THEN 'cooldown' END, CASE WHEN mode IN ('OFF', 'SHADOW') AND NOT trained THEN 'training' END, CASE WHEN mode IN ('OFF', 'SHADOW') AND NOT validated THEN 'holdout' END, CASE WHEN mode = 'CANARY' AND guard <> 'HEALTHY' THEN CASE WHEN guard = 'COLLECTING' THEN 'guard_collecting' ELSE 'guard' END END,
  CASE WHEN mode = 'CANARY' AND target_rate = 1 AND ope <> 'READY' THEN CASE WHEN ope = 'COLLECTING' THEN 'off_policy_collecting' ELSE 'off_policy' END END], lambda x: x IS NOT NULL) AS bl FROM t)
SELECT id, CASE WHEN mode = 'ACTIVE' THEN 'COMPLETE' WHEN NOT cool THEN 'COOLDOWN' WHEN len(bl) > 0 THEN 'HOLD' ELSE 'READY' END AS state, CASE WHEN target_rate = 1 THEN 'ACTIVE' ELSE 'CANARY' END AS target_mode, target_rate, CASE WHEN mode = 'ACTIVE' THEN '' ELSE array_to_string(bl, ',') END AS blockers FROM b""",
)
def progressive_delivery(spark, sf_dir):
    k = F.col("s_suppkey")
    pick = lambda xs, i: F.get(F.array(*[F.lit(x) for x in xs]), i.cast("int"))
    start = F.lit("2024-01-02").cast("timestamp")
    d = table(spark, sf_dir, "supplier").select(
        k.alias("id"), pick(["OFF", "SHADOW", "CANARY", "CANARY", "ACTIVE"], k % 5).alias("mode"), pick([0.0, 0.05, 0.1, 0.25, 0.5], k % 7 % 5).alias("rate"), F.when(k % 4 != 0, F.lit("2024-01-01").cast("timestamp")).otherwise(start).alias("created_at"), start.alias("now"),
        (k % 3 != 0).alias("trained"), (k % 2 == 0).alias("validated"), pick(["HEALTHY", "HEALTHY", "COLLECTING", "VIOLATED"], k % 11 % 4).alias("guard"), pick(["READY", "COLLECTING", "REGRESSION"], k % 13 % 3).alias("off_policy"),
    )
    return V.delivery_ladder(d).select("id", "state", "target_mode", "target_rate", "blockers")


@query(
    "artifact_registry",
    "WITH v AS (SELECT p_brand, p_type, min(p_partkey) AS created_at, sha256('{\"p_brand\":\"' || p_brand || '\",\"p_type\":\"' || p_type || '\"}') AS version FROM part GROUP BY 1, 2) SELECT version, created_at, p_brand, p_type FROM v WHERE version NOT IN (SELECT version FROM v WHERE created_at <= 5) ORDER BY created_at DESC, version LIMIT 20",
)
def artifact_registry(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_brand", "p_type", F.col("p_partkey").alias("created_at"))
    known = part.where("created_at <= 5").select(F.sha2(F.to_json(F.struct("p_brand", "p_type")), 256).alias("version"))
    return V.registered(part, known, ["p_brand", "p_type"], 20)


@query("variant_rotation", "SELECT p_partkey AS case_no, k AS place, ['baseline', 'single', 'multi', 'adaptive'][(p_partkey + 1 + k) % 4 + 1] AS variant FROM part, (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS k)")
def variant_rotation(spark, sf_dir):
    return V.rotated(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("case_no")), ["baseline", "single", "multi", "adaptive"], 1)


@query("contiguous_turns", "SELECT conv_id, min(turn) = 0 AND max(turn) + 1 = count(DISTINCT turn) AS whole FROM conversations GROUP BY 1")
def contiguous_turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(V.contiguous(F.collect_set((F.col("turn") + 1).cast("int"))).alias("whole"))


@query(
    "service_metrics",
    f"WITH {RUNS_SQL} SELECT count(*) AS n, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'FAILED') AS failed, {R('count(*) FILTER (status = $$COMPLETED$$) / count(*)::DOUBLE', 6)} AS completion_rate, count(reward) AS rewarded, {S('avg(reward)', 6)} AS avg_reward, count(cost) AS measured, {S('avg(cost)', 6)} AS avg_cost, {S('avg(latency_ms)', 6)} AS avg_latency, count(*) FILTER (mode = 'ADAPTIVE_MULTI_AGENT') AS multi FROM runs",
)
def service_metrics(spark, sf_dir):
    return V.service_metrics(runs(spark, sf_dir))


@query("blind_holdout", "SELECT doc_id AS seed_id, lang AS mode, CAST(row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS INTEGER) AS place FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) QUALIFY place <= 15")
def blind_holdout(spark, sf_dir):
    seeds = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seed_id"), F.col("lang").alias("mode"))
    return V.blind_holdout(seeds, table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "seed_id"), 15)
