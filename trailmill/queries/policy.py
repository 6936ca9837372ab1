"""Policy learning, hold-out, off-policy value, guard and drift over the run view."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmill.catalog import query
from trailmill.functions.numeric import traffic_fraction
from trailmill.operators import policy as P
from trailmill.plans.views import FRACTION_SQL, RUNS_SQL, routing_key, runs
from trailmill.plans.views import jround_sql as R

#: Segments of the driver's tables hardly differ, so the bar for a lift is set low enough for rules to exist.
CFG = P.Config(success_reward=0.3, min_samples=8, min_lift=0.002)

_PENALTY = "(0.05::DOUBLE * least(1.0::DOUBLE, {c} / 0.02::DOUBLE) + 0.05::DOUBLE * least(1.0::DOUBLE, {l} / 60000.0::DOUBLE))"


def _stats_sql(source: str = "runs") -> str:
    return f"""stats0 AS (
  SELECT CASE WHEN grouping(bucket) = 1 THEN 'GLOBAL' ELSE 'CONTEXTUAL' END AS scope, CASE WHEN grouping(bucket) = 1 THEN '' ELSE bucket END AS bucket, mode, count(*) AS n,
    count(*) FILTER (status = 'COMPLETED' AND reward >= 0.3) AS successes, count(cost) AS measured, avg(reward) AS r, coalesce(avg(cost), 0) AS c, avg(latency_ms) AS l
  FROM {source} WHERE status IN ('COMPLETED', 'FAILED') GROUP BY GROUPING SETS ((bucket, mode), (mode))),
stats AS (SELECT scope, bucket, mode, n, successes, measured, {R("r")} AS avg_reward, {R("c")} AS avg_cost, {R("l")} AS avg_latency, {R("r - " + _PENALTY.format(c="c", l="l"))} AS utility FROM stats0)"""


_RULES = f"""wide AS (SELECT scope, bucket, coalesce(max(n) FILTER (mode = 'SINGLE_AGENT'), 0) AS n_single, coalesce(max(n) FILTER (mode <> 'SINGLE_AGENT'), 0) AS n_multi,
  coalesce(max(utility) FILTER (mode = 'SINGLE_AGENT'), 0) AS u_single, coalesce(max(utility) FILTER (mode <> 'SINGLE_AGENT'), 0) AS u_multi FROM stats GROUP BY ALL),
lifted AS (SELECT *, least(n_single, n_multi) AS evidence, {R("u_multi - u_single")} AS lift FROM wide),
rules AS (SELECT scope, bucket, n_single, n_multi, u_single, u_multi, lift, evidence >= 8 AS ready, evidence >= 8 AND abs(lift) >= 0.002::DOUBLE AS deployable,
  CASE WHEN lift >= 0.002::DOUBLE THEN 'ADAPTIVE_MULTI_AGENT' ELSE 'SINGLE_AGENT' END AS recommended,
  CASE WHEN evidence >= 8 THEN {R("0.55::DOUBLE * least(1.0::DOUBLE, evidence / 24.0::DOUBLE) + 0.45::DOUBLE * least(1.0::DOUBLE, abs(lift) / (0.002::DOUBLE * 3))")} ELSE 0 END AS confidence FROM lifted)"""

_TARGET = """targeted AS (SELECT r.*, coalesce(c.recommended, g.recommended) AS target FROM runs r LEFT JOIN rules c ON c.scope = 'CONTEXTUAL' AND c.deployable AND c.bucket = r.bucket LEFT JOIN rules g ON g.scope = 'GLOBAL' AND g.deployable)"""


@query("policy_mode_stats", f"WITH {RUNS_SQL}, {_stats_sql()} SELECT * FROM stats")
def policy_mode_stats(spark, sf_dir):
    return P.mode_stats(runs(spark, sf_dir), CFG)


@query("policy_utility_grouping_sets", f"WITH {RUNS_SQL}, {_stats_sql()}, {_RULES} SELECT * FROM rules")
def policy_rules(spark, sf_dir):
    return P.learned_rules(P.mode_stats(runs(spark, sf_dir), CFG), CFG)


_DECISIONS = f"""decided AS (SELECT *, target IS NOT NULL AND target <> mode AS differ, target IS NOT NULL AND {FRACTION_SQL} < 0.25::DOUBLE AS selected FROM targeted)"""


@query(
    "routing_decisions_canary",
    f"WITH {RUNS_SQL}, {_stats_sql()}, {_RULES}, {_TARGET}, {_DECISIONS} SELECT run_id, bucket, mode AS deterministic, coalesce(target, mode) AS candidate, CASE WHEN selected THEN coalesce(target, mode) ELSE mode END AS chosen, "
    "selected AND differ AS applied, selected, CASE WHEN differ THEN CASE WHEN selected THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END ELSE 1.0::DOUBLE END AS probability, differ AS exploration FROM decided",
)
def routing_decisions(spark, sf_dir):
    base = runs(spark, sf_dir)
    return P.decisions(base, P.learned_rules(P.mode_stats(base, CFG), CFG), "CANARY", 0.25, routing_key())


_SPLIT = """placed AS (SELECT *, row_number() OVER (ORDER BY completed_at, run_id) AS rn, count(*) OVER () AS total FROM runs WHERE status IN ('COMPLETED', 'FAILED')),
split AS (SELECT *, rn > total - least(total - 1, greatest(8, CAST(ceil(total * 0.25::DOUBLE) AS BIGINT))) AS validation FROM placed), training AS (SELECT * FROM split WHERE NOT validation)"""


@query("temporal_split", f"WITH {RUNS_SQL}, {_SPLIT} SELECT run_id, validation FROM split")
def temporal_split(spark, sf_dir):
    return P.temporal_split(P.eligible(runs(spark, sf_dir))).select("run_id", "validation")


@query(
    "temporal_holdout_lcb",
    f"""WITH {RUNS_SQL}, {_SPLIT}, {_stats_sql("training")}, {_RULES},
u AS (SELECT bucket, mode, {R("reward - " + _PENALTY.format(c="coalesce(cost, 0)", l="latency_ms"))} AS u FROM split WHERE validation),
per AS (SELECT CASE WHEN grouping(bucket) = 1 THEN 'GLOBAL' ELSE 'CONTEXTUAL' END AS scope, CASE WHEN grouping(bucket) = 1 THEN '' ELSE bucket END AS bucket, mode, count(*) AS n, avg(u) AS m, coalesce(var_samp(u) / count(*), 0) AS v FROM u GROUP BY GROUPING SETS ((bucket, mode), (mode))),
w AS (SELECT r.scope, r.bucket, r.recommended, coalesce(s.n, 0) AS n_single, coalesce(x.n, 0) AS n_multi, (coalesce(x.m, 0) - coalesce(s.m, 0)) * CASE WHEN recommended = 'SINGLE_AGENT' THEN -1 ELSE 1 END AS lift, sqrt(coalesce(s.v, 0) + coalesce(x.v, 0)) AS se
  FROM rules r LEFT JOIN per s ON s.scope = r.scope AND s.bucket = r.bucket AND s.mode = 'SINGLE_AGENT' LEFT JOIN per x ON x.scope = r.scope AND x.bucket = r.bucket AND x.mode <> 'SINGLE_AGENT' WHERE deployable)
SELECT scope, bucket, recommended, n_single, n_multi, {R("lift", 6)} AS lift, {R("se", 6)} AS standard_error, {R("lift - 1.959963984540054::DOUBLE * se", 6)} AS lower_bound, n_single >= 4 AND n_multi >= 4 AND lift - 1.959963984540054::DOUBLE * se >= 0 AS passed FROM w""",
)
def temporal_holdout(spark, sf_dir):
    split = P.temporal_split(P.eligible(runs(spark, sf_dir)))
    return P.holdout(split, P.learned_rules(P.mode_stats(split.where(~F.col("validation")), CFG), CFG), CFG)


_LOGGED = f"""logged AS (SELECT *, CASE WHEN {FRACTION_SQL} < 0.25::DOUBLE THEN 0.25::DOUBLE WHEN run_id % 11 = 0 THEN 0.0::DOUBLE ELSE 0.75::DOUBLE END AS p, run_id % 5 <> 0 AS exploration FROM targeted WHERE status IN ('COMPLETED', 'FAILED'))"""


@query(
    "snips_off_policy",
    f"""WITH {RUNS_SQL}, {_stats_sql()}, {_RULES}, {_TARGET}, {_LOGGED},
f AS (SELECT *, p > 0 AS ok, p > 0 AND exploration AND target IS NOT NULL AS el, p > 0 AND exploration AND target = mode AS hit, CASE WHEN p > 0 THEN least(20.0::DOUBLE, 1 / p) END AS w FROM logged),
a AS (SELECT count(*) FILTER (ok) AS logged, count(*) FILTER (ok AND exploration) AS exploratory, count(*) FILTER (el) AS eligible, count(*) FILTER (el AND mode = 'SINGLE_AGENT') AS single, count(*) FILTER (el AND mode <> 'SINGLE_AGENT') AS multi,
  count(*) FILTER (hit) AS matched, {R("sum(reward) FILTER (el) / count(*) FILTER (el)")} AS b, {R("sum(w * reward) FILTER (hit) / sum(w) FILTER (hit)")} AS v, sum(w) FILTER (hit) AS sw, {R("pow(sum(w) FILTER (hit), 2) / sum(w * w) FILTER (hit)")} AS ess FROM f),
s AS (SELECT avg(pow(reward - b, 2)) FILTER (el) AS bv, sum(w * pow(reward - v, 2)) FILTER (hit) AS tv FROM f, a),
z AS (SELECT *, {R("v - b")} AS lift, {R("sqrt(tv / sw / ess + bv / eligible)")} AS se FROM a, s)
SELECT logged, exploratory, eligible, single, multi, matched, {R("b", 6)} AS behavior_reward, {R("v", 6)} AS policy_reward, {R("ess", 4)} AS effective_samples, {R("lift", 6)} AS lift, {R("se", 6)} AS standard_error, {R(R("lift - 1.96::DOUBLE * se"), 6)} AS lower_bound,
  CASE WHEN single < 20 OR multi < 20 OR ess < 20 OR matched = 0 THEN 'COLLECTING' WHEN {R("lift - 1.96::DOUBLE * se")} >= -0.03::DOUBLE THEN 'READY' ELSE 'REGRESSION' END AS state FROM z""",
)
def snips(spark, sf_dir):
    base = runs(spark, sf_dir)
    known = P.with_target(P.eligible(base), P.learned_rules(P.mode_stats(base, CFG), CFG))
    p = F.when(traffic_fraction(routing_key()) < 0.25, 0.25).when(F.col("run_id") % 11 == 0, 0.0).otherwise(0.75)
    return P.snips(known.withColumn("probability", p).withColumn("exploration", F.col("run_id") % 5 != 0))


def _cohort_sql(source: str, flag: str) -> str:
    return f"""co AS (SELECT {flag} AS flag, count(*) AS n, count(cost) AS measured, {R("avg(reward)")} AS reward, {R("avg(grounding)")} AS grounding, {R("count(*) FILTER (status = 'COMPLETED') / count(*)::DOUBLE")} AS completion, {R("avg(latency_ms)")} AS latency, {R("coalesce(avg(cost), 0)")} AS cost FROM {source} GROUP BY 1)"""


def _bad_sql(a: str, b: str) -> str:
    drop = ", ".join(f"CASE WHEN {a}.{m} - {b}.{m} < -0.05::DOUBLE THEN '{m}' END" for m in ("reward", "grounding", "completion"))
    return f"list_filter([{drop}, CASE WHEN {a}.latency / {b}.latency > 1.5::DOUBLE THEN 'latency' END, CASE WHEN {a}.measured > 0 AND {b}.measured > 0 AND {a}.cost / {b}.cost > 1.5::DOUBLE THEN 'cost' END], lambda x: x IS NOT NULL)"


_SIX = ("n", "reward", "grounding", "completion", "latency", "cost")


@query(
    "canary_guard",
    f"""WITH {RUNS_SQL}, seen AS (SELECT *, {FRACTION_SQL} < 0.25::DOUBLE AS selected FROM (SELECT * FROM runs ORDER BY completed_at DESC, run_id LIMIT 1000) WHERE run_id % 4 <> 0), {_cohort_sql("seen", "selected")},
j AS (SELECT a AS canary, b AS control, {_bad_sql("a", "b")} AS bad FROM (SELECT * FROM co WHERE flag) a, (SELECT * FROM co WHERE NOT flag) b)
SELECT CASE WHEN canary.n < 20 OR control.n < 20 THEN 'COLLECTING' WHEN len(bad) > 0 THEN 'VIOLATED' ELSE 'HEALTHY' END AS state, CASE WHEN canary.n < 20 OR control.n < 20 THEN '' ELSE array_to_string(bad, ',') END AS violations,
  {", ".join(f"{R(f'{s}.{m}', 6)} AS {s}_{m}" for s in ("canary", "control") for m in _SIX)} FROM j""",
)
def canary_guard(spark, sf_dir):
    tagged = runs(spark, sf_dir).withColumn("rollout", F.when(F.col("run_id") % 4 != 0, "CANARY").otherwise("SHADOW")).withColumn("selected", traffic_fraction(routing_key()) < 0.25)
    return P.canary_guard(tagged)


@query(
    "drift_js",
    f"""WITH {RUNS_SQL}, c AS (SELECT *, completed_at < TIMESTAMP '1996-01-01' AS reference FROM runs), seen AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY reference ORDER BY completed_at DESC, run_id) <= 500), {_cohort_sql("seen", "reference")},
sh AS (SELECT {R("count(*) FILTER (reference) / max(na)::DOUBLE")} AS p, {R("count(*) FILTER (NOT reference) / max(nb)::DOUBLE")} AS q FROM seen, (SELECT count(*) FILTER (reference) AS na, count(*) FILTER (NOT reference) AS nb FROM seen) GROUP BY bucket),
js AS (SELECT {R("sum(CASE WHEN p > 0 THEN 0.5::DOUBLE * p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5::DOUBLE * q * log2(q / ((p + q) / 2)) ELSE 0 END)")} AS js FROM sh),
j AS (SELECT a AS cur, b AS ref, js, list_concat(CASE WHEN js > 0.2::DOUBLE THEN ['features'] ELSE [] END, {_bad_sql("a", "b")}) AS bad FROM (SELECT * FROM co WHERE NOT flag) a, (SELECT * FROM co WHERE flag) b, js)
SELECT CASE WHEN ref.n < 20 OR cur.n < 30 THEN 'COLLECTING' WHEN len(bad) > 0 THEN 'DRIFTED' ELSE 'HEALTHY' END AS state, {R("js", 6)} AS js_divergence, CASE WHEN ref.n < 20 OR cur.n < 30 THEN '' ELSE array_to_string(bad, ',') END AS violations, ref.n AS n_reference, cur.n AS n_active FROM j""",
)
def drift(spark, sf_dir):
    return P.drift(runs(spark, sf_dir).withColumn("reference", F.col("completed_at") < F.lit("1996-01-01").cast("timestamp")))


@query(
    "violation_streaks",
    """WITH d AS (SELECT event_type AS monitor, date_trunc('day', ts) AS day, avg(value) AS v FROM events GROUP BY 1, 2), a AS (SELECT event_type AS monitor, avg(value) AS m FROM events GROUP BY 1),
c AS (SELECT d.monitor, day, CASE WHEN v < m THEN 'DRIFTED' ELSE 'HEALTHY' END AS state FROM d JOIN a USING (monitor)),
g AS (SELECT *, sum(CASE WHEN state = 'DRIFTED' THEN 0 ELSE 1 END) OVER (PARTITION BY monitor ORDER BY day) AS g FROM c),
s AS (SELECT *, CAST(sum(CASE WHEN state = 'DRIFTED' THEN 1 ELSE 0 END) OVER (PARTITION BY monitor, g ORDER BY day) AS BIGINT) AS streak FROM g)
SELECT monitor, day, state, streak, streak >= 3 AS rolled_back FROM s""",
)
def violation_streaks(spark, sf_dir):
    from trailmill.sources.tables import table

    events = table(spark, sf_dir, "events")
    days = events.groupBy(F.col("event_type").alias("monitor"), F.date_trunc("day", "ts").alias("day")).agg(F.avg("value").alias("v"))
    mean = events.groupBy(F.col("event_type").alias("monitor")).agg(F.avg("value").alias("m"))
    return P.streaks(days.join(mean, "monitor").select("monitor", "day", F.when(F.col("v") < F.col("m"), "DRIFTED").otherwise("HEALTHY").alias("state")), order="day")
