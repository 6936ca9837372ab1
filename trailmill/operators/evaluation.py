"""Answer scoring, A/B comparison, release gates, paired statistics and bootstrap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmill.functions.digests import leading_words
from trailmill.functions.numeric import jround, stable
from trailmill.functions.text import any_phrase, citations, concept_coverage, length_quality
from trailmill.operators.seeds import placed

WINNER_MARGIN, CRITICAL_DROP = 0.03, 0.15
_TASK_DRAWS, _DRAWS_AT_ONCE = 4_000_000, 1 << 15


def answer_scores(answers: DataFrame) -> DataFrame:
    """Adds concept, direct, citation, forbidden, length and total scores.

    answers: answer, required (array), forbidden (array), min_chars, max_chars, need_citation, failed. A failed or
    blank answer scores 0 throughout. total = .5 concept + .15 direct + .15 citation + .1 forbidden + .1 length.
    """
    dead = F.col("failed") | F.col("answer").isNull() | (F.trim(F.coalesce("answer", F.lit(""))) == "")
    text = F.coalesce("answer", F.lit(""))
    live = lambda c: F.when(dead, 0.0).otherwise(c)
    concept = live(concept_coverage(text, F.col("required")))
    direct = live(F.when(F.length(F.trim(text)) > 0, 1.0).otherwise(0.0))
    citation = live(F.when(~F.col("need_citation") | (F.size(citations(text)) > 0), 1.0).otherwise(0.0))
    forbidden = live(F.when(any_phrase(text, F.col("forbidden")), 0.0).otherwise(1.0))
    length = live(length_quality(text, F.col("min_chars"), F.col("max_chars")))
    out = answers.withColumns({"concept": concept, "direct": direct, "citation": citation, "forbidden_free": forbidden, "length": length})
    return out.withColumn("total", jround(0.5 * F.col("concept") + 0.15 * F.col("direct") + 0.15 * F.col("citation") + 0.1 * F.col("forbidden_free") + 0.1 * F.col("length"), 4))


def variant_summary(executions: DataFrame, *by: str) -> DataFrame:
    """Per variant: mean score, pass rate (score of .7 and more), latency, tokens, cost, failures."""
    return executions.groupBy(*by).agg(
        F.count("*").alias("n"),
        stable(F.avg("score"), 6).alias("avg_score"),
        stable(F.avg((F.col("score") >= 0.7).cast("double")), 6).alias("pass_rate"),
        stable(F.avg("latency_ms"), 6).alias("avg_latency"),
        F.sum("tokens").alias("tokens"),
        stable(F.sum("cost"), 4).alias("cost"),
        F.count_if("failed").alias("failures"),
    )


def tag_slices(executions: DataFrame) -> DataFrame:
    """The summary by tag and variant; a case counts once for each different tag."""
    return variant_summary(executions.withColumn("tag", F.explode(F.array_distinct("tags"))), "tag", "variant")


def comparisons(executions: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """One row per case that both variants ran: delta, winner and whether the loss is critical. One shuffle: a conditional aggregate, no self-join."""
    of = lambda v, c: F.max(F.when(F.col("variant") == v, F.col(c)))
    wide = executions.where(F.col("variant").isin(baseline, candidate)).groupBy("case_id").agg(of(baseline, "score").alias("base"), of(candidate, "score").alias("cand"), of(baseline, "failed").alias("base_failed"), of(candidate, "failed").alias("cand_failed"))
    delta = jround(F.col("cand") - F.col("base"), 6)
    out = wide.where("base IS NOT NULL AND cand IS NOT NULL").withColumn("delta", delta)
    winner = F.when(F.col("delta") >= WINNER_MARGIN, "candidate").when(F.col("delta") <= -WINNER_MARGIN, "baseline").otherwise("tie")
    return out.select("case_id", "base", "cand", "delta", winner.alias("winner"), ((F.col("delta") < -CRITICAL_DROP) | (~F.col("base_failed") & F.col("cand_failed"))).alias("critical"))


def worst(compared: DataFrame, n: int = 10) -> DataFrame:
    return compared.where("delta < 0").orderBy("delta", "case_id").limit(n)


def release_gates(executions: DataFrame, min_score: float = 0.72, max_regression: float = 0.02, min_route: float = 0.8, max_cost_ratio: float = 1.10) -> DataFrame:
    """One row of six gate verdicts for the candidate, and the names of those that fail.

    executions: case_id, variant (baseline, single, multi, candidate), score, cost, measured (whether usage is known),
    failed, mode, expected_mode (null: any is right). Cost is compared with the forced variant of the candidate's own
    route, the oracle, and only if usage is known for all; a case is critical as in ``comparisons``.
    """
    of = lambda v, c: F.max(F.when(F.col("variant") == v, F.col(c)))
    names = {"baseline": "b", "candidate": "c", "single": "s", "multi": "m"}
    wide = executions.groupBy("case_id").agg(*[of(v, c).alias(f"{k}_{c}") for v, k in names.items() for c in ("score", "cost", "measured", "failed")], of("candidate", "mode").alias("mode"), of("candidate", "expected_mode").alias("expected"))
    wide = wide.where("b_score IS NOT NULL AND c_score IS NOT NULL")
    own = lambda c: F.when(F.col("mode") == "ADAPTIVE_MULTI_AGENT", F.col(f"m_{c}")).otherwise(F.col(f"s_{c}"))
    critical = (jround(F.col("c_score") - F.col("b_score"), 6) < -CRITICAL_DROP) | (~F.col("b_failed") & F.col("c_failed"))
    one = wide.agg(
        F.count("*").alias("cases"), stable(F.avg("c_score"), 6).alias("score"), stable(F.avg("b_score"), 6).alias("baseline_score"), stable(F.avg(F.coalesce(F.col("expected") == F.col("mode"), F.lit(True)).cast("double")), 6).alias("route_accuracy"),
        F.bool_and(F.coalesce(F.col("c_measured") & own("measured"), F.lit(False))).alias("comparable"), F.sum("c_cost").alias("_c"), F.sum(own("cost")).alias("_o"), F.count_if(critical).alias("critical_cases"), F.count_if("c_failed").alias("_cf"), F.count_if("b_failed").alias("_bf"),
    )
    ratio = F.when(~F.col("comparable"), 0.0).when(F.col("_o") > 0, stable(F.col("_c") / F.when(F.col("_o") > 0, F.col("_o")), 4)).when(F.col("_c") > 0, F.lit(float("inf"))).otherwise(1.0)
    one = one.withColumn("cost_ratio", ratio)
    good = {
        "score": F.col("score") >= min_score,
        "regression": F.col("score") + max_regression >= F.col("baseline_score"),
        "route": F.col("route_accuracy") >= min_route,
        "cost": ~F.col("comparable") | (F.col("cost_ratio") <= max_cost_ratio),
        "critical": F.col("critical_cases") == 0,
        "failures": F.col("_cf") <= F.col("_bf"),
    }
    failed = F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), k) for k, ok in good.items()])), ",")
    return one.select("cases", "score", "baseline_score", "route_accuracy", "comparable", "cost_ratio", "critical_cases", failed.alias("failed"))


def paired_stats(pairs: DataFrame, margin: float = 0.02) -> DataFrame:
    """One row over deltas: mean, median, sample deviation, wins, ties, losses, effect size and the exact two-sided sign test."""
    out = pairs.agg(
        F.count("*").alias("n"), F.avg("delta").alias("mean"), F.percentile("delta", 0.5).alias("median"), F.coalesce(F.stddev_samp("delta"), F.lit(0.0)).alias("sd"),
        F.count_if(F.col("delta") > 0).alias("wins"), F.count_if(F.col("delta") == 0).alias("ties"), F.count_if(F.col("delta") < 0).alias("losses"),
    )
    return out.select("n", jround("mean", 6).alias("mean"), jround("median", 6).alias("median"), jround("sd", 6).alias("sd"), "wins", "ties", "losses", jround(F.when(F.col("sd") > 1e-12, F.col("mean") / F.col("sd")).otherwise(0.0), 6).alias("effect"), jround(sign_test(F.col("wins"), F.col("losses")), 6).alias("sign_p"))


def sign_test(wins: Column, losses: Column) -> Column:
    """min(1, 2 P(X <= min(wins, losses))) for X ~ Binomial(wins + losses, 1/2), summed in logarithms so that no power underflows."""
    n, k = wins + losses, F.least(wins, losses)
    step = lambda acc, i: F.struct((acc["c"] + F.log(((n - i + 1) / i).cast("double"))).alias("c"), (acc["s"] + F.exp(acc["c"] + F.log(((n - i + 1) / i).cast("double")))).alias("s"))
    start = -n * F.log(F.lit(2.0))
    tail = F.when(k > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long")), F.struct(start.cast("double").alias("c"), F.exp(start.cast("double")).alias("s")), step, lambda a: a["s"])).otherwise(F.exp(start.cast("double")))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def _drawn(seed: str, n: int, draws: int, step: int, values: Broadcast | None):
    """From first numbers of ``step`` draws each to (b, s, c): what the draws of a replicate among them sum up to, and how many have a value;
    without values to (b, k): each draw's pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first in (x for batch in batches for x in batch.column(0).to_pylist()):
            ids = np.arange(first, min(first + step, draws))
            b, i = np.divmod(ids, n)
            k = (leading_words(seed, b, i) % n).astype(np.int32)
            if values is None:
                yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(k)], names=["b", "k"])
                continue
            taken, starts = values.value[k], np.flatnonzero(np.diff(b, prepend=-1))
            known = ~np.isnan(taken)
            yield pa.RecordBatch.from_arrays([pa.array(b[starts]), pa.array(np.add.reduceat(np.where(known, taken, 0.0), starts)), pa.array(np.add.reduceat(known.astype(np.int64), starts))], names=["b", "s", "c"])

    return run


def bootstrap(pairs: DataFrame, replicates: int, seed: str, broadcast_pairs: int = 2_000_000) -> DataFrame:
    """Paired bootstrap of the mean delta: 95 % interval by linear quantiles, share above 0.

    Draw i of replicate b is the pair with number hash(seed, b, i) mod n: the same in every engine and on any
    partitioning. Pairs are the cases of a test set, numbered in the order of their ids (whole numbers by ranges, not in
    one partition); up to ``broadcast_pairs`` their deltas go to every task (8 bytes each), which sums up its draws, and beyond they are joined by number,
    where every draw is shuffled. Draws are one range of numbers, of which a row is a block's first: a sequence of n constants would be folded into the plan.
    """
    spark = pairs.sparkSession
    whole = pairs.schema["case_id"].dataType.simpleString() in ("int", "bigint")
    numbered = placed(pairs, "case_id", "k").select(F.col("k").cast("int").alias("k"), "delta") if whole else pairs.selectExpr("cast(row_number() over (order by case_id) - 1 as int) as k", "delta")
    n = pairs.count()
    if not n:
        return spark.createDataFrame([], "n long, replicates long, low double, high double, above double")
    draws = replicates * n
    tasks = max(spark.sparkContext.defaultParallelism, draws // _TASK_DRAWS)
    step = max(1, min(_DRAWS_AT_ONCE, draws // tasks))
    blocks = spark.range(0, draws, step, tasks)
    if n <= broadcast_pairs:
        known = numbered.toArrow()
        deltas = np.full(n, np.nan)
        deltas[known["k"].to_numpy()] = known["delta"].to_numpy().astype(np.float64)
        sums = blocks.mapInArrow(_drawn(seed, n, draws, step, spark.sparkContext.broadcast(deltas)), "b long, s double, c long").groupBy("b").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
        means = sums.select("b", jround(F.when(F.col("c") > 0, F.col("s") / F.when(F.col("c") > 0, F.col("c"))), 8).alias("m"))
    else:
        means = blocks.mapInArrow(_drawn(seed, n, draws, step, None), "b long, k int").join(numbered, "k").groupBy("b").agg(jround(F.avg("delta"), 8).alias("m"))
    return means.agg(F.lit(n).cast("long").alias("n"), F.count("*").alias("replicates"), jround(F.percentile("m", 0.025), 6).alias("low"), jround(F.percentile("m", 0.975), 6).alias("high"), jround(F.avg((F.col("m") > 0).cast("double")), 6).alias("above"))


def arm_report(arms: DataFrame, baseline: str) -> DataFrame:
    """Each arm against the baseline arm: score delta, cost ratio, whether the case sets agree. arms: arm, case_id, score, cost."""
    per = arms.groupBy("arm").agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("cases"), F.sum(F.xxhash64("case_id").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key"), F.avg("score").alias("s"), F.sum("cost").alias("c"))
    base = per.where(F.col("arm") == baseline).select(F.col("key").alias("bkey"), F.col("s").alias("bs"), F.col("c").alias("bc"))
    out = per.crossJoin(F.broadcast(base))  # one row
    return out.select("arm", "n", "cases", (F.col("key") == F.col("bkey")).alias("comparable"), jround(F.col("s") - F.col("bs"), 6).alias("score_delta"), jround(F.when(F.col("bc") > 0, F.col("c") / F.col("bc")).otherwise(0.0), 6).alias("cost_ratio"))


def precision_recall(labelled: DataFrame, *by: str) -> DataFrame:
    """Confusion counts and rates per group and overall. labelled: predicted, actual (boolean)."""
    p, a = F.col("predicted"), F.col("actual")
    rate = lambda x, y: F.when(y > 0, jround(x / F.when(y > 0, y), 6)).otherwise(0.0)
    grouped = labelled.groupingSets([list(by), []], *by) if by else labelled.groupBy()
    keys = [F.when(F.grouping(c) == 1, "ALL").otherwise(F.col(c)) for c in by]
    out = grouped.agg(*[k.alias(f"_{c}") for k, c in zip(keys, by, strict=True)], F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count("*").alias("n"))
    return out.select(*[F.col(f"_{c}").alias(c) for c in by], "n", "tp", "fp", "fn", rate(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), rate(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), rate(F.col("tp") + F.col("fp"), F.col("n")).alias("coverage"))


def threshold_grid(scored: DataFrame, thresholds: list[int], min_n: int = 10, min_precision: float = 0.8) -> DataFrame:
    """Smallest threshold whose selection is large, precise and holds no negative: at most one row. scored: value, positive, negative.

    The grid is a short constant list, exploded per row and summed up before the shuffle.
    """
    each = scored.select(F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"), "value", "positive", "negative").where(F.col("value") <= F.col("threshold"))
    out = each.groupBy("threshold").agg(F.count("*").alias("n"), F.avg(F.col("positive").cast("double")).alias("precision"), F.count_if("negative").alias("negatives"))
    return out.where((F.col("n") >= min_n) & (F.col("precision") >= min_precision) & (F.col("negatives") == 0)).orderBy("threshold").limit(1).select("threshold", "n", jround("precision", 6).alias("precision"))
