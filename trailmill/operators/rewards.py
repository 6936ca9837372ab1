"""Rubric rewards, judge aggregation, calibration, candidate choice and cost bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmill.functions.numeric import clamp, jround, stable
from trailmill.functions.text import answer_units, multiset_overlap, says, stripped


def first_step(steps: Column, kind: str) -> Column:
    return F.try_element_at(F.filter(steps, lambda s: s["type"] == kind), F.lit(1))


def last_step(steps: Column, kind: str) -> Column:
    return F.try_element_at(F.filter(steps, lambda s: s["type"] == kind), F.lit(-1))


def online_reward(runs: DataFrame) -> DataFrame:
    """Adds the eight parts of the online reward and ``total``.

    runs: n_documents, grounding (GROUNDED, PARTIAL or other), sufficient (boolean), task (0..1), model_calls,
    follow_ups, rating (1..5 or null), specialists, specialist_ok, process (0..1).
    """
    parts = {
        "retrieval": clamp(F.col("n_documents") / 2.0),
        "grounded": F.when(F.col("grounding") == "GROUNDED", 1.0).when(F.col("grounding") == "PARTIAL", 0.7).otherwise(0.0),
        "evidence": F.when(F.col("sufficient").isNull(), 0.0).when(F.col("sufficient"), 1.0).otherwise(0.25),
        "task_quality": clamp(F.coalesce("task", F.lit(0.0))),
        "efficiency": clamp(1 - 0.08 * F.greatest(F.lit(0), F.col("model_calls") - 4) - 0.12 * F.col("follow_ups")),
        "feedback": F.when(F.col("rating").isNull(), 0.5).otherwise((F.col("rating") - 1) / 4.0),
        "collaboration": F.when(F.col("specialists") > 0, 0.65 * F.col("process") + 0.35 * F.col("specialist_ok") / F.greatest(F.col("specialists"), F.lit(1))).otherwise(0.0),
    }
    out = runs.withColumns(parts)
    weights = {"retrieval": 0.20, "grounded": 0.25, "evidence": 0.15, "task_quality": 0.20, "efficiency": 0.10, "feedback": 0.10}
    base = sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0))
    return out.withColumn("total", stable(F.when(F.col("specialists") > 0, 0.9 * base + 0.1 * F.col("collaboration")).otherwise(base), 6))


def token_f1(answer: Column, solution: Column) -> Column:
    a, b = answer_units(answer), answer_units(solution)
    same = multiset_overlap(a, b)
    p, r = same / F.greatest(F.size(a), F.lit(1)), same / F.greatest(F.size(b), F.lit(1))
    return F.when(same > 0, 2 * p * r / F.when(same > 0, p + r)).otherwise(0.0)


# Weights of the verifier and shares of the total.
VERIFIER = {"retrieval": 0.20, "grounding": 0.25, "convergence": 0.15, "task": 0.25, "collaboration": 0.05, "efficiency": 0.10}
VERIFIER_SHARE, JUDGE_SHARE = 0.45, 0.55


def hard_checks(runs: DataFrame, min_grounding: float = 0.7) -> DataFrame:
    """Adds ``reasons``: why a run may not be used at all, empty if it may. Without a reward nothing further is checked."""
    filled = lambda c: says(F.col(c))
    ended = ~F.coalesce(F.col("status") == "COMPLETED", F.lit(False)) | filled("error")
    rewarded = F.col("grounding").isNotNull()
    rules = {"not_completed": ended, "blank_text": ~filled("question") | ~filled("answer"), "no_reward": ~rewarded, "grounding": rewarded & (F.col("grounding") < min_grounding), "task": rewarded & (F.col("task") <= 0)}
    return runs.withColumn("reasons", F.array_compact(F.array(*[F.when(bad, k) for k, bad in rules.items()])))


def assessed(runs: DataFrame, scores: DataFrame, min_judges: int = 4, min_agreement: float = 0.7, min_confidence: float = 0.72, high: float = 0.75, low: float = 0.35, min_grounding: float = 0.7) -> DataFrame:
    """One row per run: verifier, judge and total reward, agreement, confidence, and the first rung of the ladder that holds.

    runs: run_id, status, error, question, answer, rating (null: none), evaluation_only, and the parts of ``VERIFIER``
    (all null: no reward). scores: run_id, seq, judge, dimension, score, confidence; the first of a judge and dimension counts.
    """
    named = scores.where(F.col("dimension").isNotNull() & says(F.col("judge")))
    one = named.groupBy("run_id", stripped(F.col("judge")).alias("judge"), "dimension").agg(F.min(F.struct("seq", "score", "confidence")).alias("s"))
    one = one.select("run_id", "dimension", clamp(F.col("s.score")).alias("x"), clamp(F.col("s.confidence")).alias("c"))
    w = F.greatest(F.lit(0.05), F.col("c"))
    g = one.groupBy("run_id").agg((F.sum(F.col("x") * w) / F.sum(w)).alias("ai"), F.avg("c").alias("mc"), F.count("*").alias("n"), F.countDistinct("dimension").alias("dims"))
    spread = one.join(g.select("run_id", "ai"), "run_id").groupBy("run_id").agg(F.avg(F.abs(F.col("x") - F.col("ai"))).alias("spread"))
    d = hard_checks(runs, min_grounding).join(g, "run_id", "left").join(spread, "run_id", "left").na.fill(0, ["ai", "mc", "n", "dims", "spread"])
    agreement = F.when(F.col("n") < 2, 0.0).otherwise(clamp(1 - 2 * F.col("spread")))
    verifier = clamp(sum((F.coalesce(k, F.lit(0.0)) * x for k, x in VERIFIER.items()), F.lit(0.0)))
    d = d.withColumns({"agreement": agreement, "verifier": verifier})
    d = d.withColumns({"sure": clamp(F.col("mc") * F.col("agreement") * F.least(F.lit(1.0), F.col("dims") / float(min_judges))), "total": stable(VERIFIER_SHARE * F.col("verifier") + JUDGE_SHARE * F.col("ai"), 4)})
    rated = F.col("rating").isNotNull()
    hold = lambda: F.struct(F.lit("UNLABELED").alias("label"), F.lit("HOLDOUT").alias("decision"))
    rung = lambda label, decision: F.struct(F.lit(label).alias("label"), (F.lit(decision) if isinstance(decision, str) else decision).alias("decision"))
    human = F.when(F.col("rating") >= 4, "POSITIVE").when(F.col("rating") <= 2, "NEGATIVE").otherwise("HOLDOUT")
    ladder = (
        F.when(F.col("evaluation_only"), rung("EVALUATION_ONLY", "EXCLUDED")).when(F.size("reasons") > 0, rung("REJECTED", "EXCLUDED")).when(rated, rung("HUMAN_LABELED", human))
        .when(F.col("n") < min_judges, hold()).when(stable("agreement", 10) < min_agreement, hold()).when(stable("sure", 10) < min_confidence, hold())
        .when(F.col("total") >= high, rung("PSEUDO_LABELED", "POSITIVE")).when(F.col("total") <= low, rung("PSEUDO_LABELED", "NEGATIVE")).otherwise(hold())
    )
    human_rung = ~F.col("evaluation_only") & (F.size("reasons") == 0) & rated
    return d.withColumn("r", ladder).select(
        "run_id", "r.label", "r.decision", stable("verifier", 4).alias("verifier"), stable("ai", 4).alias("ai"), "total", F.when(human_rung, 1.0).otherwise(stable("sure", 4)).alias("confidence"), stable("agreement", 4).alias("agreement"), "n", F.array_join("reasons", ",").alias("reasons")
    )


def alignment_metrics(assessments: DataFrame, min_agreement: float = 0.7) -> DataFrame:
    """Per label and decision: runs, mean total, share of runs with two scores or more that disagree."""
    apart = F.avg(F.when(F.col("n") >= 2, (F.col("agreement") < min_agreement).cast("double")))
    return assessments.groupBy("label", "decision").agg(F.count("*").alias("n"), stable(F.avg("total"), 6).alias("avg_total"), jround(F.coalesce(apart, F.lit(0.0)), 6).alias("disagreement"))


def ridge(rows: DataFrame, strength: float = 0.1) -> DataFrame:
    """One row: y = a + b x1 + c x2 by ridge regression with a free intercept, from sums alone; and the mean absolute error.

    The 2 x 2 centred system has a closed form, so nothing is solved on the driver.
    """
    s = rows.agg(*[F.avg(c).alias(c) for c in ("x1", "x2", "y")], F.covar_pop("x1", "x2").alias("s12"), F.var_pop("x1").alias("s11"), F.var_pop("x2").alias("s22"), F.covar_pop("x1", "y").alias("s1y"), F.covar_pop("x2", "y").alias("s2y"), F.count("*").alias("n"))
    k = F.lit(strength) / F.col("n")
    a11, a22, a12 = F.col("s11") + k, F.col("s22") + k, F.col("s12")
    det = a11 * a22 - a12 * a12
    b = s.withColumn("b1", (F.col("s1y") * a22 - F.col("s2y") * a12) / det).withColumn("b2", (F.col("s2y") * a11 - F.col("s1y") * a12) / det)
    b = b.withColumn("b0", F.col("y") - F.col("b1") * F.col("x1") - F.col("b2") * F.col("x2")).select("b0", "b1", "b2", "n")
    error = rows.crossJoin(F.broadcast(b)).agg(F.avg(F.abs(F.col("y") - F.col("b0") - F.col("b1") * F.col("x1") - F.col("b2") * F.col("x2"))).alias("mae"))  # one row of coefficients
    return b.crossJoin(error).select("n", *[jround(c, 5).alias(c) for c in ("b0", "b1", "b2", "mae")])


def chosen_revision(rows: DataFrame) -> DataFrame:
    """Draft or revision by given scores: an integer score times 100000 plus a tie-break; only a strictly better revision wins."""
    value = lambda s: F.floor(F.col(f"{s}_score") * 100) * 100000 + F.floor(F.col(f"{s}_coverage") * 1000)
    return rows.withColumn("winner", F.when(value("revised") > value("draft"), "revised").otherwise("draft"))


def cost_bound(rows: DataFrame, input_price: float, output_price: float, dimensions: int = 4) -> DataFrame:
    """Upper bounds of judge calls, tokens and cost. rows: question_chars, answer_chars; prices per million tokens.

    A prompt has 600 characters of its own and 1.25 tokens a character; an answer has 200 tokens at most.
    """
    prompt = F.col("question_chars") + F.col("answer_chars") + 600
    out = rows.agg(F.count("*").alias("n"), (F.coalesce(F.sum(F.ceil(prompt * 1.25)), F.lit(0)) * dimensions).alias("input_tokens"))
    out = out.withColumns({"calls": F.col("n") * dimensions, "output_tokens": F.col("n") * 200 * dimensions})
    return out.select("n", "calls", "input_tokens", "output_tokens", jround((F.col("input_tokens") * input_price + F.col("output_tokens") * output_price) / 1e6, 8).alias("cost"))


def process_reward(rows: DataFrame) -> DataFrame:
    """Specialist process: .2 for findings, .3 for recommendations, .3 with known sources and .1 without, .2 of the confidence; 0 on failure.

    rows: success, findings and recommendations (texts), sources (numbers), max_source, confidence. Sources are cut to
    known distinct numbers, at most 12.
    """
    known = F.slice(F.array_distinct(F.filter("sources", lambda s: (s >= 1) & (s <= F.col("max_source")))), 1, 12)
    out = rows.withColumn("known", known)
    said = lambda c, x: F.when(says(F.col(c)), x).otherwise(0.0)
    whole = said("findings", 0.2) + said("recommendations", 0.3) + F.when(F.size("known") > 0, 0.3).otherwise(0.1) + 0.2 * clamp(F.col("confidence"))
    return out.withColumn("process", F.when(F.col("success"), jround(F.least(F.lit(1.0), whole), 6)).otherwise(0.0))


def routed(questions: DataFrame, domains: dict[str, list[str]], minimum: int = 2, most: int = 3, structured: str = "|") -> DataFrame:
    """Deterministic router: domains by keyword, structure and length marks, complexity, mode and bucket. questions: text."""
    low = F.lower(F.coalesce("text", F.lit("")))
    hit = F.array_compact(F.array(*[F.when(F.exists(F.array(*[F.lit(k) for k in ks]), lambda k: F.contains(low, k)), d) for d, ks in domains.items()]))
    out = questions.withColumn("domains", hit).withColumn("structured", low.contains(structured)).withColumn("long", F.length(F.coalesce("text", F.lit(""))) >= 70)
    d = F.size("domains")
    out = out.withColumn("complexity", jround(F.least(F.lit(1.0), 0.18 * d + 0.25 * F.col("structured").cast("int") + 0.15 * F.col("long").cast("int")), 6))
    mode = F.when((d >= minimum) | (F.col("structured") & (d >= 2)), "ADAPTIVE_MULTI_AGENT").otherwise("SINGLE_AGENT")
    bucket = F.concat(F.array_join(F.array_sort("domains"), "+"), F.lit("|structured="), F.col("structured").cast("string"), F.lit("|long="), F.col("long").cast("string"))
    return out.withColumn("mode", mode).withColumn("agents", F.slice("domains", 1, most)).withColumn("bucket", bucket)
