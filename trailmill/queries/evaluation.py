"""Evaluation queries over test views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmill.catalog import query
from trailmill.operators import evaluation as E
from trailmill.plans.views import jround_sql as R
from trailmill.plans.views import stable_sql as S
from trailmill.sources.tables import table

#: Cases are part keys; the variants are the return flags of their lines, scored by discount.
_EXEC = f"""ex AS (SELECT l_partkey AS case_id, CASE l_returnflag WHEN 'A' THEN 'baseline' WHEN 'R' THEN 'candidate' ELSE 'adaptive' END AS variant, {R("0.6::DOUBLE + avg(l_discount) * 4", 6)} AS score,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS latency_ms, count(*) * 100 AS tokens, {R("sum(l_tax)", 6)} AS cost, min(l_linenumber) > 3 AS failed FROM lineitem GROUP BY 1, 2),
tagged AS (SELECT ex.*, [p_brand, p_type, p_brand] AS tags FROM ex JOIN part ON p_partkey = case_id)"""


def executions(spark, sf_dir):
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    variant = F.when(F.col("l_returnflag") == "A", "baseline").when(F.col("l_returnflag") == "R", "candidate").otherwise("adaptive")
    from trailmill.functions.numeric import jround

    ex = lines.groupBy(F.col("l_partkey").alias("case_id"), variant.alias("variant")).agg(
        jround(0.6 + F.avg("l_discount") * 4, 6).alias("score"), F.sum(F.col("l_quantity").cast("long")).alias("latency_ms"), (F.count("*") * 100).alias("tokens"), jround(F.sum("l_tax"), 6).alias("cost"), (F.min("l_linenumber") > 3).alias("failed")
    )
    return ex.join(part, ex["case_id"] == part["p_partkey"]).select(*ex.columns, F.array("p_brand", "p_type", "p_brand").alias("tags"))


_SUM = f"count(*) AS n, {S('avg(score)', 6)} AS avg_score, {S('avg(CASE WHEN score >= 0.7::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', 6)} AS pass_rate, {S('avg(latency_ms)', 6)} AS avg_latency, CAST(sum(tokens) AS BIGINT) AS tokens, {S('sum(cost)', 4)} AS cost, count(*) FILTER (failed) AS failures"
_CMP = f"""w AS (SELECT case_id, max(score) FILTER (variant = 'baseline') AS base, max(score) FILTER (variant = 'candidate') AS cand, bool_or(failed) FILTER (variant = 'baseline') AS bf, bool_or(failed) FILTER (variant = 'candidate') AS cf FROM ex GROUP BY 1),
c AS (SELECT case_id, base, cand, {R("cand - base", 6)} AS delta, bf, cf FROM w WHERE base IS NOT NULL AND cand IS NOT NULL)"""


@query("variant_summary", f"WITH {_EXEC} SELECT variant, {_SUM} FROM tagged GROUP BY 1")
def variant_summary(spark, sf_dir):
    return E.variant_summary(executions(spark, sf_dir), "variant")


@query("tag_slices", f"WITH {_EXEC}, t AS (SELECT * EXCLUDE (tags), unnest(list_distinct(tags)) AS tag FROM tagged) SELECT tag, variant, {_SUM} FROM t GROUP BY 1, 2")
def tag_slices(spark, sf_dir):
    return E.tag_slices(executions(spark, sf_dir))


_VERDICT = "CASE WHEN delta >= 0.03::DOUBLE THEN 'candidate' WHEN delta <= -0.03::DOUBLE THEN 'baseline' ELSE 'tie' END AS winner, delta < -0.15::DOUBLE OR (NOT bf AND cf) AS critical"


@query("ab_comparisons", f"WITH {_EXEC}, {_CMP} SELECT case_id, base, cand, delta, {_VERDICT} FROM c")
def ab_comparisons(spark, sf_dir):
    return E.comparisons(executions(spark, sf_dir), "baseline", "candidate")


@query("worst_regressions", f"WITH {_EXEC}, {_CMP} SELECT case_id, base, cand, delta, {_VERDICT} FROM c WHERE delta < 0 ORDER BY delta, case_id LIMIT 10")
def worst_regressions(spark, sf_dir):
    return E.worst(E.comparisons(executions(spark, sf_dir), "baseline", "candidate"))


@query(
    "release_gates",
    f"""WITH g AS (SELECT l_partkey AS case_id, l_linenumber % 4 AS v, {R("0.6::DOUBLE + avg(l_discount) * 4", 6)} AS score, {R("sum(l_tax)", 6)} AS cost, min(l_quantity) > 40 AS failed FROM lineitem GROUP BY 1, 2),
w AS (SELECT case_id, case_id % 2 = 0 AS multi, max(score) FILTER (v = 0) AS b, max(score) FILTER (v = 1) AS c, bool_or(failed) FILTER (v = 0) AS bf, bool_or(failed) FILTER (v = 1) AS cf, max(cost) FILTER (v = 1) AS cc, CASE WHEN case_id % 2 = 0 THEN max(cost) FILTER (v = 3) ELSE max(cost) FILTER (v = 2) END AS oc FROM g GROUP BY 1),
o AS (SELECT count(*) AS cases, {S("avg(c)", 6)} AS score, {S("avg(b)", 6)} AS baseline_score, {S("avg(CASE WHEN case_id % 10 = 3 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END)", 6)} AS route_accuracy, bool_and(oc IS NOT NULL) AS comparable, sum(cc) AS cc, sum(oc) AS oc, count(*) FILTER ({R("c - b", 6)} < -0.15::DOUBLE OR (NOT bf AND cf)) AS critical_cases, count(*) FILTER (cf) AS ncf, count(*) FILTER (bf) AS nbf FROM w WHERE b IS NOT NULL AND c IS NOT NULL),
r AS (SELECT *, CASE WHEN NOT comparable THEN 0.0::DOUBLE WHEN oc > 0 THEN {S("cc / oc", 4)} WHEN cc > 0 THEN 'inf'::DOUBLE ELSE 1.0::DOUBLE END AS cost_ratio FROM o)
SELECT cases, score, baseline_score, route_accuracy, comparable, cost_ratio, critical_cases, array_to_string(list_filter([CASE WHEN score < 0.72::DOUBLE THEN 'score' END, CASE WHEN score + 0.02::DOUBLE < baseline_score THEN 'regression' END, CASE WHEN route_accuracy < 0.8::DOUBLE THEN 'route' END, CASE WHEN comparable AND cost_ratio > 1.1::DOUBLE THEN 'cost' END, CASE WHEN critical_cases > 0 THEN 'critical' END, CASE WHEN ncf > nbf THEN 'failures' END], lambda x: x IS NOT NULL), ',') AS failed FROM r""",
)
def release_gates(spark, sf_dir):
    from trailmill.functions.numeric import jround

    variant = F.element_at(F.array(*[F.lit(v) for v in ("baseline", "candidate", "single", "multi")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    ex = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("case_id"), variant.alias("variant")).agg(jround(0.6 + F.avg("l_discount") * 4, 6).alias("score"), jround(F.sum("l_tax"), 6).alias("cost"), (F.min("l_quantity") > 40).alias("failed"))
    mode = F.when(F.col("case_id") % 2 == 0, "ADAPTIVE_MULTI_AGENT").otherwise("SINGLE_AGENT")
    return E.release_gates(ex.withColumns({"measured": F.lit(True), "mode": mode, "expected_mode": F.when(F.col("case_id") % 10 == 3, "ADAPTIVE_MULTI_AGENT").when(F.col("case_id") % 7 != 0, mode)}))


@query(
    "paired_delta_stats",
    f"""WITH {_EXEC}, {_CMP}, s AS (SELECT count(*) AS n, avg(delta) AS m, quantile_cont(delta, 0.5) AS med, stddev_samp(delta) AS sd, count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta = 0) AS ties, count(*) FILTER (delta < 0) AS losses FROM c),
p AS (SELECT sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2))) AS tail FROM (SELECT wins, losses, unnest(range(0, least(wins, losses) + 1)) AS i FROM s))
SELECT n, {R("m", 6)} AS mean, {R("med", 6)} AS median, {R("sd", 6)} AS sd, wins, ties, losses, {R("m / sd", 6)} AS effect, {R("least(1, 2 * tail)", 6)} AS sign_p FROM s, p""",
)
def paired_delta_stats(spark, sf_dir):
    return E.paired_stats(E.comparisons(executions(spark, sf_dir), "baseline", "candidate"))


@query(
    "bootstrap_hash",
    f"""WITH {_EXEC}, {_CMP}, k AS (SELECT row_number() OVER (ORDER BY case_id) - 1 AS k, delta FROM c), n AS (SELECT count(*) AS n FROM k),
d AS (SELECT b, CAST('0x' || substr(sha256('release|' || b || '|' || i), 1, 8) AS BIGINT) % n AS k FROM (SELECT unnest(range(0, 10000)) AS b), (SELECT n, unnest(range(0, n)) AS i FROM n)), m AS (SELECT b, {R("avg(delta)")} AS m FROM d JOIN k USING (k) GROUP BY 1)
SELECT max(n) AS n, count(*) AS replicates, {R("quantile_cont(m, 0.025)", 6)} AS low, {R("quantile_cont(m, 0.975)", 6)} AS high, {R("avg(CASE WHEN m > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)", 6)} AS above FROM m, n""",
)
def bootstrap_hash(spark, sf_dir):
    pairs = E.comparisons(executions(spark, sf_dir), "baseline", "candidate").select("case_id", "delta")
    return E.bootstrap(pairs, 10_000, "release")


@query(
    "four_arm_report",
    f"""WITH {_EXEC}, a AS (SELECT variant AS arm, count(*) AS n, count(DISTINCT case_id) AS cases, avg(score) AS s, sum(cost) AS c, list(DISTINCT case_id ORDER BY case_id) AS ids FROM tagged GROUP BY 1), b AS (SELECT s AS bs, c AS bc, ids AS bids FROM a WHERE arm = 'baseline')
SELECT arm, n, cases, ids = bids AS comparable, {R("s - bs", 6)} AS score_delta, {R("c / bc", 6)} AS cost_ratio FROM a, b""",
)
def four_arm_report(spark, sf_dir):
    return E.arm_report(executions(spark, sf_dir).withColumnRenamed("variant", "arm"), "baseline")


_LABELLED = "lab AS (SELECT lang, length(text) >= 400 AS predicted, quality = 1 AS actual, length(text) AS v FROM documents JOIN labels USING (doc_id))"


def _labelled(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select("lang", (F.length("text") >= 400).alias("predicted"), (F.col("quality") == 1).alias("actual"), F.length("text").alias("v"))


@query(
    "label_precision_recall",
    f"WITH {_LABELLED}, g AS (SELECT CASE WHEN grouping(lang) = 1 THEN 'ALL' ELSE lang END AS lang, count(*) AS n, count(*) FILTER (predicted AND actual) AS tp, count(*) FILTER (predicted AND NOT actual) AS fp, count(*) FILTER (NOT predicted AND actual) AS fn FROM lab GROUP BY GROUPING SETS ((lang), ())) "
    f"SELECT lang, n, tp, fp, fn, CASE WHEN tp + fp > 0 THEN {R('tp / (tp + fp)::DOUBLE', 6)} ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN {R('tp / (tp + fn)::DOUBLE', 6)} ELSE 0 END AS recall, {R('(tp + fp) / n::DOUBLE', 6)} AS coverage FROM g",
)
def label_precision_recall(spark, sf_dir):
    return E.precision_recall(_labelled(spark, sf_dir), "lang")


@query(
    "threshold_grid",
    f"WITH {_LABELLED}, g AS (SELECT t AS threshold, count(*) AS n, avg(CASE WHEN actual THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p FROM lab, (SELECT unnest(range(80, 601, 25)) AS t) WHERE v <= t GROUP BY 1) SELECT CAST(threshold AS INTEGER) AS threshold, n, {R('p', 6)} AS precision FROM g WHERE n >= 10 AND p >= 0.8::DOUBLE ORDER BY threshold LIMIT 1",
)
def threshold_grid(spark, sf_dir):
    scored = _labelled(spark, sf_dir).select(F.col("v").alias("value"), F.col("actual").alias("positive"), F.lit(False).alias("negative"))
    return E.threshold_grid(scored, list(range(80, 601, 25)))


_ANSWERS = "an AS (SELECT conv_id, turn, text AS answer, [split_part(text, ' ', 1), 'zzz|the'] AS required, ['qqq'] AS forbidden, 100 AS lo, 600 AS hi, turn % 5 = 3 AS need, turn > 6 AS failed FROM conversations WHERE role = 'assistant')"


@query(
    "answer_scores",
    f"""WITH {_ANSWERS}, s AS (SELECT *, failed OR trim(answer) = '' AS dead, len(list_filter(required, lambda c: len(list_filter(string_split(c, '|'), lambda a: contains(lower(answer), lower(trim(a))))) > 0)) / 2.0::DOUBLE AS cc,
  CASE WHEN NOT need OR regexp_matches(answer, '\\[来源\\s*[0-9]{{1,6}}\\]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ci, CASE WHEN contains(answer, 'qqq') THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS fo,
  CASE WHEN length(answer) < lo THEN length(answer) / lo::DOUBLE WHEN length(answer) > hi THEN hi / length(answer)::DOUBLE ELSE 1 END AS le FROM an)
SELECT conv_id, turn, CASE WHEN dead THEN 0.0::DOUBLE ELSE {R("0.5::DOUBLE * cc + 0.15::DOUBLE + 0.15::DOUBLE * ci + 0.1::DOUBLE * fo + 0.1::DOUBLE * le", 4)} END AS total FROM s""",
)
def answer_scores(spark, sf_dir):
    a = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    a = a.select("conv_id", "turn", F.col("text").alias("answer"), F.array(F.split_part("text", F.lit(" "), F.lit(1)), F.lit("zzz|the")).alias("required"), F.array(F.lit("qqq")).alias("forbidden"), F.lit(100).alias("min_chars"), F.lit(600).alias("max_chars"), (F.col("turn") % 5 == 3).alias("need_citation"), (F.col("turn") > 6).alias("failed"))
    return E.answer_scores(a).select("conv_id", "turn", "total")
