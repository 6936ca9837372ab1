"""Routing policies learned from runs, their hold-out test, off-policy value, canary guard and drift.

Runs have: run_id, bucket, mode, status, completed_at, reward, grounding, cost (null: not measured), latency_ms.
A missing reward counts as 0; costs are averaged over measured runs only; an empty average is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmill.functions.numeric import exact_sum, jround, mean_or_zero, traffic_fraction

SINGLE, MULTI = "SINGLE_AGENT", "ADAPTIVE_MULTI_AGENT"


@dataclass(frozen=True)
class Config:
    success_reward: float = 0.7
    min_samples: int = 8
    min_lift: float = 0.03
    cost_weight: float = 0.05
    cost_budget: float = 0.02
    latency_weight: float = 0.05
    latency_budget_ms: float = 60000.0
    max_runs: int | None = None


def eligible(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status").isin("COMPLETED", "FAILED") & F.col("mode").isNotNull())


def newest(runs: DataFrame, n: int | None, *partition: str) -> DataFrame:
    """The newest ``n`` runs (per partition); ties by run_id."""
    if n is None:
        return runs
    order = [F.desc("completed_at"), F.asc("run_id")]
    if not partition:
        return runs.orderBy(*order).limit(n)
    w = Window.partitionBy(*partition).orderBy(*order)
    return runs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def penalty(cost: Column, latency: Column, cfg: Config) -> Column:
    return cfg.cost_weight * F.least(F.lit(1.0), cost / cfg.cost_budget) + cfg.latency_weight * F.least(F.lit(1.0), latency / cfg.latency_budget_ms)


def mode_stats(runs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Per (bucket, mode) and, with a null bucket, per mode over all runs. Limit after eligibility, before the mode filter."""
    seen = newest(eligible(runs), cfg.max_runs).where(F.col("mode").isin(SINGLE, MULTI))
    reward = F.coalesce("reward", F.lit(0.0))
    stats = seen.withColumn("b", F.col("bucket")).groupingSets([["b", "mode"], ["mode"]], "b", "mode").agg(
        F.grouping("b").alias("is_global"),
        F.count("*").alias("n"),
        F.count_if((F.col("status") == "COMPLETED") & F.col("reward").isNotNull() & (reward >= cfg.success_reward)).alias("successes"),
        F.count("cost").alias("measured"),
        mean_or_zero(reward).alias("r"),
        mean_or_zero(F.col("cost")).alias("c"),
        mean_or_zero(F.col("latency_ms")).alias("l"),
    )
    stats = stats.where((F.col("is_global") == 1) | (F.trim("b") != ""))
    return stats.select(
        F.when(F.col("is_global") == 1, "GLOBAL").otherwise("CONTEXTUAL").alias("scope"),
        F.when(F.col("is_global") == 1, "").otherwise(F.col("b")).alias("bucket"),
        "mode", "n", "successes", "measured",
        jround("r").alias("avg_reward"), jround("c").alias("avg_cost"), jround("l").alias("avg_latency"),
        jround(F.col("r") - penalty(F.col("c"), F.col("l"), cfg)).alias("utility"),
    )


def learned_rules(stats: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row per scope and bucket: lift of the multi-agent mode, whether it is deployable, and its confidence."""
    of = lambda m, c: F.coalesce(F.max(F.when(F.col("mode") == m, F.col(c))), F.lit(0))
    wide = stats.groupBy("scope", "bucket").agg(of(SINGLE, "n").alias("n_single"), of(MULTI, "n").alias("n_multi"), of(SINGLE, "utility").alias("u_single"), of(MULTI, "utility").alias("u_multi"))
    n = F.least("n_single", "n_multi")
    lift = jround(F.col("u_multi") - F.col("u_single"))
    base = wide.select("*", n.alias("evidence"), lift.alias("lift"), (n >= cfg.min_samples).alias("ready"))
    confidence = jround(0.55 * F.least(F.lit(1.0), F.col("evidence") / (cfg.min_samples * 3.0)) + 0.45 * F.least(F.lit(1.0), F.abs("lift") / (cfg.min_lift * 3)))
    return base.select(
        "scope", "bucket", "n_single", "n_multi", "u_single", "u_multi", "lift", "ready",
        (F.col("ready") & (F.abs("lift") >= cfg.min_lift)).alias("deployable"),
        F.when(F.col("lift") >= cfg.min_lift, MULTI).otherwise(SINGLE).alias("recommended"),
        F.when(F.col("ready"), confidence).otherwise(0.0).alias("confidence"),
    )


def targets(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deployable rules: per bucket, and the global one (at most one row)."""
    good = rules.where("deployable").select("scope", "bucket", "recommended")
    return good.where("scope = 'CONTEXTUAL'").select("bucket", F.col("recommended").alias("by_bucket")), good.where("scope = 'GLOBAL'").select(F.col("recommended").alias("by_all"))


def with_target(runs: DataFrame, rules: DataFrame) -> DataFrame:
    """Contextual rule, else the global one, else null. Buckets are few by nature; the join plan is left to the optimizer."""
    by_bucket, by_all = targets(rules)
    out = runs.join(by_bucket, "bucket", "left").join(by_all.withColumn("_one", F.lit(1)), F.lit(1) == F.col("_one"), "left")
    return out.withColumn("target", F.coalesce("by_bucket", "by_all")).drop("by_bucket", "by_all", "_one")


def decisions(runs: DataFrame, rules: DataFrame, rollout: str, rate: float, key: Column | None = None) -> DataFrame:
    """What a deployment would do with each run, whose ``mode`` is the deterministic choice. rollout: SHADOW, CANARY or ACTIVE."""
    known = with_target(runs, rules)
    candidate = F.coalesce("target", "mode")
    differ = F.col("target").isNotNull() & (F.col("target") != F.col("mode"))
    selected = F.col("target").isNotNull() & (traffic_fraction(F.col("run_id").cast("string") if key is None else key) < rate)
    if rollout == "CANARY":
        chosen, applied, sel = F.when(selected, candidate).otherwise(F.col("mode")), selected & differ, selected
        probability = F.when(differ, F.when(selected, rate).otherwise(1 - rate)).otherwise(1.0)
        explore = differ & F.lit(rate < 1)
    else:
        chosen = candidate if rollout == "ACTIVE" else F.col("mode")
        applied, sel = (differ if rollout == "ACTIVE" else F.lit(False)), F.lit(False)
        probability, explore = F.lit(1.0), F.lit(False)
    return known.select("run_id", "bucket", F.col("mode").alias("deterministic"), candidate.alias("candidate"), chosen.alias("chosen"), applied.alias("applied"), sel.alias("selected"), jround(probability).alias("probability"), explore.alias("exploration"))


def temporal_split(runs: DataFrame, min_per_mode: int = 4, ratio: float = 0.25) -> DataFrame:
    """``validation``: whether a run is among the last max(2 min, ceil(ratio n)), at most n - 1, by time and id.

    The place of a run comes from ranks within days plus the sum of earlier days, so no task sorts all runs.
    """
    day = F.to_date("completed_at")
    within = Window.partitionBy("_day").orderBy("completed_at", "run_id")
    days = runs.groupBy(day.alias("_day")).agg(F.count("*").alias("_n"))
    earlier = days.select("_day", (F.sum("_n").over(Window.orderBy(F.asc_nulls_first("_day"))) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    placed = runs.withColumn("_day", day).withColumn("_rn", F.row_number().over(within)).join(earlier, "_day")
    held = F.least(F.col("_all") - 1, F.greatest(F.lit(2 * min_per_mode), F.ceil(F.col("_all") * F.lit(ratio))))
    return placed.withColumn("validation", (F.col("_all") >= 2) & (F.col("_rn") + F.col("_before") > F.col("_all") - held)).drop("_day", "_rn", "_before", "_all")


def holdout(split: DataFrame, rules: DataFrame, cfg: Config = Config(), min_per_mode: int = 4, floor: float = 0.0) -> DataFrame:
    """Each deployable rule on the validation runs: oriented lift, its standard error and 95 % lower bound."""
    u = jround(F.coalesce("reward", F.lit(0.0)) - penalty(F.coalesce("cost", F.lit(0.0)), F.col("latency_ms"), cfg))
    seen = split.where(F.col("validation") & F.col("mode").isin(SINGLE, MULTI)).select("bucket", "mode", u.alias("u"))
    per = seen.groupingSets([["bucket", "mode"], ["mode"]], "bucket", "mode").agg(F.grouping("bucket").alias("g"), F.count("*").alias("n"), F.avg("u").alias("m"), F.coalesce(F.var_samp("u") / F.count("*"), F.lit(0.0)).alias("v"))
    keyed = per.select(F.when(F.col("g") == 1, "GLOBAL").otherwise("CONTEXTUAL").alias("scope"), F.when(F.col("g") == 1, "").otherwise(F.col("bucket")).alias("bucket"), "mode", "n", "m", "v")
    of = lambda m, c: F.coalesce(F.max(F.when(F.col("mode") == m, F.col(c))), F.lit(0))
    wide = keyed.groupBy("scope", "bucket").agg(*[of(m, c).alias(f"{c}_{k}") for k, m in (("single", SINGLE), ("multi", MULTI)) for c in ("n", "m", "v")])
    zero = dict.fromkeys(("n_single", "n_multi", "m_single", "m_multi", "v_single", "v_multi"), 0)
    tested = rules.where("deployable").select("scope", "bucket", "recommended").join(wide, ["scope", "bucket"], "left").na.fill(zero)
    gap = F.col("m_multi") - F.col("m_single")
    lift = F.when(F.col("recommended") == MULTI, gap).otherwise(-gap)
    se = F.sqrt(F.col("v_single") + F.col("v_multi"))
    bound = lift - 1.959963984540054 * se
    enough = (F.col("n_single") >= min_per_mode) & (F.col("n_multi") >= min_per_mode)
    return tested.select("scope", "bucket", "recommended", "n_single", "n_multi", jround(lift, 6).alias("lift"), jround(se, 6).alias("standard_error"), jround(bound, 6).alias("lower_bound"), (enough & (bound >= floor)).alias("passed"))


def snips(logged: DataFrame, cap: float = 20.0, min_per_action: int = 20, min_ess: float = 20.0, max_regression: float = 0.03) -> DataFrame:
    """Self-normalised inverse propensity value of the target rules: one row.

    logged: mode, reward, target, probability, exploration. Means are rounded before the variances are taken
    around them, as the report does; those come from a second aggregate, not from a formula that cancels. Weights are summed
    exactly but for their last bits: few of them differ, and a running sum of equal numbers errs the same way at each step.
    """
    ok = F.col("probability").isNotNull() & ~F.isnan("probability") & (F.col("probability") > 0) & (F.col("probability") <= 1)
    reward, weight = F.coalesce("reward", F.lit(0.0)), F.least(F.lit(cap), F.when(ok, 1 / F.when(ok, F.col("probability"))))
    flagged = logged.withColumn("ok", ok).withColumn("el", F.col("ok") & F.col("exploration") & F.col("target").isNotNull() & F.col("mode").isin(SINGLE, MULTI))
    flagged = flagged.withColumn("hit", F.col("el") & (F.col("target") == F.col("mode"))).withColumn("r", reward).withColumn("w", weight)
    s = lambda c, on: F.coalesce(F.sum(F.when(F.col(on), c)), F.lit(0.0))
    first = flagged.agg(
        F.count_if("ok").alias("logged"), F.count_if(F.col("ok") & F.col("exploration")).alias("exploratory"), F.count_if("el").alias("eligible"),
        F.count_if(F.col("el") & (F.col("mode") == SINGLE)).alias("single"), F.count_if(F.col("el") & (F.col("mode") == MULTI)).alias("multi"), F.count_if("hit").alias("matched"),
        s(F.col("r"), "el").alias("br"), exact_sum(F.when(F.col("hit"), F.col("w")), cap).alias("sw"), exact_sum(F.when(F.col("hit"), F.col("w") * F.col("w")), cap * cap).alias("sww"), s(F.col("w") * F.col("r"), "hit").alias("swr"),
    )
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(jround(a / F.when(b == 0, F.lit(None)).otherwise(b)))
    first = first.select("*", ratio(F.col("br"), F.col("eligible")).alias("behavior"), ratio(F.col("swr"), F.col("sw")).alias("policy"), ratio(F.col("sw") * F.col("sw"), F.col("sww")).alias("ess"))
    spread = flagged.where("el").crossJoin(F.broadcast(first.select("behavior", "policy"))).agg(  # one row: an aggregate without keys
        F.coalesce(F.avg(F.pow(F.col("r") - F.col("behavior"), 2)), F.lit(0.0)).alias("bv"), s(F.col("w") * F.pow(F.col("r") - F.col("policy"), 2), "hit").alias("tv")
    )
    out = first.crossJoin(spread).withColumn("lift", jround(F.col("policy") - F.col("behavior")))
    tv = F.when(F.col("sw") == 0, 0.0).otherwise(F.col("tv") / F.col("sw"))
    se = F.when((F.col("ess") == 0) | (F.col("eligible") == 0), 0.0).otherwise(jround(F.sqrt(tv / F.col("ess") + F.col("bv") / F.col("eligible"))))
    out = out.withColumn("se", se).withColumn("bound", jround(F.col("lift") - 1.96 * F.col("se")))
    ready = (F.col("single") >= min_per_action) & (F.col("multi") >= min_per_action) & (F.col("ess") >= min_ess) & (F.col("matched") > 0)
    return out.select(
        "logged", "exploratory", "eligible", "single", "multi", "matched", jround("behavior", 6).alias("behavior_reward"), jround("policy", 6).alias("policy_reward"), jround("ess", 4).alias("effective_samples"),
        jround("lift", 6).alias("lift"), jround("se", 6).alias("standard_error"), jround("bound", 6).alias("lower_bound"),
        F.when(~ready, "COLLECTING").when(F.col("bound") >= -max_regression, "READY").otherwise("REGRESSION").alias("state"),
    )


def cohort_stats(runs: DataFrame, cohort: str) -> DataFrame:
    """Averages per value of the column ``cohort``, rounded to 8 digits."""
    return runs.groupBy(cohort).agg(
        F.count("*").alias("n"),
        F.count("cost").alias("measured"),
        jround(mean_or_zero(F.coalesce("reward", F.lit(0.0)))).alias("reward"),
        jround(mean_or_zero(F.coalesce("grounding", F.lit(0.0)))).alias("grounding"),
        jround(F.count_if(F.col("status") == "COMPLETED") / F.count("*")).alias("completion"),
        jround(mean_or_zero(F.col("latency_ms"))).alias("latency"),
        jround(mean_or_zero(F.col("cost"))).alias("cost"),
    )


_MEASURES = ("reward", "grounding", "completion", "latency", "cost")


def regressions(now: str, then: str, max_drop: float = 0.05, max_ratio: float = 1.5) -> Column:
    """Names of the measures of struct ``now`` that are worse than ``then``."""
    a, b = F.col(now), F.col(then)
    drop = lambda m: F.when(a[m] - b[m] < -max_drop, m)
    times = lambda m, ok: F.when(ok & (b[m] > 0) & (a[m] / F.when(b[m] > 0, b[m]) > max_ratio), m)
    always, both = F.lit(True), (a["measured"] > 0) & (b["measured"] > 0)
    return F.array_compact(F.array(drop("reward"), drop("grounding"), drop("completion"), times("latency", always), times("cost", both)))


def _sides(stats: DataFrame, flag: str, yes: str, no: str) -> DataFrame:
    fields = F.struct("n", "measured", *_MEASURES)
    empty = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("measured"), *[F.lit(0.0).alias(m) for m in _MEASURES])
    return stats.agg(F.coalesce(F.max(F.when(F.col(flag), fields)), empty).alias(yes), F.coalesce(F.max(F.when(~F.col(flag), fields)), empty).alias(no))


def canary_guard(runs: DataFrame, max_runs: int = 1000, min_canary: int = 20, min_control: int = 20) -> DataFrame:
    """Canary against control; runs: with ``rollout`` and ``selected``. The newest runs are taken before any other filter."""
    seen = newest(runs, max_runs).where("rollout = 'CANARY'")
    sides = _sides(cohort_stats(seen, "selected"), "selected", "canary", "control")
    bad = regressions("canary", "control")
    state = F.when((F.col("canary.n") < min_canary) | (F.col("control.n") < min_control), "COLLECTING").when(F.size("bad") > 0, "VIOLATED").otherwise("HEALTHY")
    out = sides.withColumn("bad", bad)
    return out.select(state.alias("state"), F.when(state == "VIOLATED", F.array_join("bad", ",")).otherwise("").alias("violations"), *[jround(F.col(f"{s}.{m}").cast("double"), 6).alias(f"{s}_{m}") for s in ("canary", "control") for m in ("n", *_MEASURES)])


def drift(runs: DataFrame, max_per_window: int = 500, min_reference: int = 20, min_active: int = 30, max_divergence: float = 0.20) -> DataFrame:
    """Active against reference runs; runs: with boolean ``reference``. The newest runs are taken per class, after classification."""
    seen = newest(runs, max_per_window, "reference")
    sides = _sides(cohort_stats(seen, "reference"), "reference", "then", "now")
    out = sides.crossJoin(divergence(seen.withColumn("bucket", F.when(F.trim(F.coalesce("bucket", F.lit(""))) == "", "UNKNOWN").otherwise(F.col("bucket"))), "reference", "bucket"))
    bad = F.concat(F.when(F.col("js") > max_divergence, F.array(F.lit("features"))).otherwise(F.array().cast("array<string>")), regressions("now", "then"))
    few = (F.col("then.n") < min_reference) | (F.col("now.n") < min_active)
    out = out.withColumn("bad", bad)
    return out.select(F.when(few, "COLLECTING").when(F.size("bad") > 0, "DRIFTED").otherwise("HEALTHY").alias("state"), jround("js", 6).alias("js_divergence"), F.when(few, "").otherwise(F.array_join("bad", ",")).alias("violations"), F.col("then.n").alias("n_reference"), F.col("now.n").alias("n_active"))


def divergence(df: DataFrame, flag: str, category: str) -> DataFrame:
    """Jensen-Shannon divergence (base 2) of a category between the two values of ``flag``; shares are rounded to 8 digits first. One row."""
    counts = df.groupBy(category).agg(F.count_if(F.col(flag)).alias("a"), F.count_if(~F.col(flag)).alias("b"))
    total = counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    share = counts.crossJoin(F.broadcast(total)).where("na > 0 AND nb > 0").select(jround(F.col("a") / F.col("na")).alias("p"), jround(F.col("b") / F.col("nb")).alias("q"))
    half = lambda x: F.when(F.col(x) > 0, 0.5 * F.col(x) * F.log2(F.col(x) / ((F.col("p") + F.col("q")) / 2))).otherwise(0.0)
    return share.agg(jround(F.coalesce(F.sum(half("p") + half("q")), F.lit(0.0))).alias("js"))


def streaks(checks: DataFrame, order: str = "at", required: int = 3) -> DataFrame:
    """Consecutive violations in time order, reset by any other state; ``rolled_back`` where the streak reaches ``required``. checks: monitor, the order column, state."""
    w = Window.partitionBy("monitor").orderBy(order)
    island = checks.withColumn("_g", F.sum(F.when(F.col("state") == "DRIFTED", 0).otherwise(1)).over(w))
    streak = F.sum(F.when(F.col("state") == "DRIFTED", 1).otherwise(0)).over(Window.partitionBy("monitor", "_g").orderBy(order))
    return island.withColumn("streak", streak).withColumn("rolled_back", F.col("streak") >= required).drop("_g")
