"""Gates over replays and collections, the delivery ladder, the artifact registry, service metrics, frozen hold-outs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmill.functions.numeric import jround, stable

STAGES = (0.05, 0.10, 0.25, 0.50)


def _verdict(row: DataFrame, checks: dict[str, Column], *shown: str) -> DataFrame:
    named = row.withColumns({k: F.coalesce(ok, F.lit(False)) for k, ok in checks.items()})
    failures = F.array_join(F.array_compact(F.array(*[F.when(~F.col(k), k) for k in checks])), ",")
    return named.select(*shown, *checks, failures.alias("failures"), (failures == "").alias("passed"))


def replay_gate(runs: DataFrame, min_reward: float, max_mismatches: int, max_timeouts: int, max_violations: int) -> DataFrame:
    """One row of seven checks. runs: status, gate, reward, n_violations, expected_mode (null: not stated), mode, timeouts."""
    evaluated = F.col("expected_mode").isNotNull() & F.col("mode").isNotNull()
    one = runs.agg(
        F.count("*").alias("planned"), F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.count_if("gate").alias("gated"), stable(F.avg("reward"), 6).alias("average"), F.coalesce(F.sum("n_violations"), F.lit(0)).alias("violations"),
        F.count("expected_mode").alias("expected"), F.count_if(evaluated).alias("evaluated"), F.count_if(evaluated & (F.col("expected_mode") != F.col("mode"))).alias("mismatches"), F.coalesce(F.sum("timeouts"), F.lit(0)).alias("timeouts"),
    )
    c = F.col
    checks = {
        "all_runs_completed": (c("planned") > 0) & (c("completed") == c("planned")),
        "all_gates_passed": (c("planned") > 0) & (c("gated") == c("planned")),
        "average_met": c("average") >= min_reward,
        "violations_within_limit": c("violations") <= max_violations,
        "routes_evaluated": (c("expected") == 0) | (c("evaluated") == c("expected")),
        "mismatches_within_limit": c("mismatches") <= max_mismatches,
        "timeouts_within_limit": c("timeouts") <= max_timeouts,
    }
    return _verdict(one, checks, "planned", "completed", "average", "violations", "mismatches", "timeouts")


def seed_reasons(runs: DataFrame, rounds: int, min_reward: float) -> DataFrame:
    """(seed_id, reasons): why a seed does not qualify; empty if it does. runs: seed_id, status, gate, reward, timeouts."""
    g = runs.groupBy("seed_id").agg(F.count("*").alias("n"), F.bool_and(F.col("status") == "COMPLETED").alias("done"), F.bool_and("gate").alias("gated"), F.min("reward").alias("least"), F.sum("timeouts").alias("late"))
    rules = {"rounds": F.col("n") == rounds, "incomplete": F.col("done"), "hard_gate": F.col("gated"), "reward": F.col("least") >= min_reward, "timeout": F.col("late") == 0}
    return g.select("seed_id", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), k) for k, ok in rules.items()])).alias("reasons"))


def collection_gate(runs: DataFrame, seeds: DataFrame, min_seeds: int) -> DataFrame:
    """One row of three checks over runs and the reasons of their seeds."""
    a = runs.agg(F.count("*").alias("planned"), F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.countDistinct("seed_id").alias("expected"))
    b = seeds.agg(F.count("*").alias("evaluated"), F.count_if(F.size("reasons") == 0).alias("qualified"))
    c = F.col
    checks = {"all_runs_completed": (c("planned") > 0) & (c("completed") == c("planned")), "all_seeds_evaluated": (c("expected") > 0) & (c("evaluated") == c("expected")), "enough_seeds": c("qualified") >= min_seeds}
    return _verdict(a.crossJoin(F.broadcast(b)), checks, "planned", "completed", "evaluated", "qualified")  # one row each


def delivery_ladder(deployments: DataFrame, cooldown: str = "INTERVAL 1 DAY", stages: tuple[float, ...] = STAGES) -> DataFrame:
    """Next step of each deployment: mode, rate, created_at, now, trained, validated, guard (HEALTHY, ...), off_policy (READY, ...).

    SHADOW goes to the first stage, CANARY to the next, the last to ACTIVE, where the off-policy value must be ready too.
    """
    up = None
    for s in sorted(stages, reverse=True):
        up = F.when(F.col("rate") < s - 1e-9, s) if up is None else F.when(F.col("rate") < s - 1e-9, s).otherwise(up)
    up = F.coalesce(up, F.lit(1.0))
    shadow, canary = F.col("mode").isin("OFF", "SHADOW"), F.col("mode") == "CANARY"
    target = F.when(shadow, F.lit(float(min(stages)))).when(canary, up).otherwise(1.0)
    cool = F.col("now") >= F.col("created_at") + F.expr(cooldown)
    active = canary & (up >= 1 - 1e-9)
    blockers = F.array_compact(
        F.array(
            F.when(~cool, "cooldown"), F.when(shadow & ~F.col("trained"), "training"), F.when(shadow & ~F.col("validated"), "holdout"),
            F.when(canary & (F.col("guard") != "HEALTHY"), F.when(F.col("guard") == "COLLECTING", "guard_collecting").otherwise("guard")),
            F.when(active & (F.col("off_policy") != "READY"), F.when(F.col("off_policy") == "COLLECTING", "off_policy_collecting").otherwise("off_policy")),
        )
    )
    state = F.when(F.col("mode") == "ACTIVE", "COMPLETE").when(~cool, "COOLDOWN").when(F.size(blockers) > 0, "HOLD").otherwise("READY")
    return deployments.select("*", state.alias("state"), F.when(target >= 1 - 1e-9, "ACTIVE").otherwise("CANARY").alias("target_mode"), target.alias("target_rate"), F.array_join(F.when(F.col("mode") == "ACTIVE", F.array().cast("array<string>")).otherwise(blockers), ",").alias("blockers"))


def registered(artifacts: DataFrame, known: DataFrame, fields: list[str], newest: int) -> DataFrame:
    """New artifacts under their content id; one that is known is left out, the newest ``newest`` stay. artifacts: created_at and the fields."""
    version = F.sha2(F.to_json(F.struct(*sorted(fields))), 256)
    fresh = artifacts.withColumn("version", version).groupBy("version").agg(F.min("created_at").alias("created_at"), *[F.first(f).alias(f) for f in fields])
    return fresh.join(known.select("version"), "version", "left_anti").orderBy(F.desc("created_at"), "version").limit(newest)


def rotated(cases: DataFrame, variants: list[str], offset: int = 0) -> DataFrame:
    """Order of the variants per case: case i starts with variant (i + offset) mod n. cases: case_no from 0."""
    n = len(variants)
    order = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.element_at(F.array(*[F.lit(v) for v in variants]), (F.pmod(F.col("case_no") + offset + k, F.lit(n)) + 1).cast("int")))
    return cases.select("case_no", F.posexplode(order).alias("place", "variant"))


def contiguous(numbers: Column) -> Column:
    """Whether the distinct numbers are exactly 1..k for some k of 1 and more."""
    d = F.array_distinct(numbers)
    return (F.size(d) > 0) & (F.array_min(d) == 1) & (F.array_max(d) == F.size(d))


def service_metrics(runs: DataFrame) -> DataFrame:
    """One row; rewards are averaged where there is one, costs where they were measured. runs: status, reward, cost, latency_ms, mode."""
    mean = lambda c: F.coalesce(stable(F.avg(c), 6), F.lit(0.0))
    return runs.agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.count_if(F.col("status") == "FAILED").alias("failed"), jround(F.count_if(F.col("status") == "COMPLETED") / F.greatest(F.count("*"), F.lit(1)), 6).alias("completion_rate"),
        F.count("reward").alias("rewarded"), mean("reward").alias("avg_reward"), F.count("cost").alias("measured"), mean("cost").alias("avg_cost"), mean("latency_ms").alias("avg_latency"), F.count_if(F.col("mode") == "ADAPTIVE_MULTI_AGENT").alias("multi"),
    )


def blind_holdout(seeds: DataFrame, used: DataFrame, per_mode: int) -> DataFrame:
    """Unused seeds, the first ``per_mode`` of each mode by SHA-256. seeds: seed_id, mode."""
    free = seeds.join(used.select("seed_id"), "seed_id", "left_anti").withColumn("h", F.sha2(F.col("seed_id").cast("string"), 256))
    return free.withColumn("place", F.row_number().over(Window.partitionBy("mode").orderBy("h", "seed_id"))).where(F.col("place") <= per_mode).select("seed_id", "mode", "place")
