"""Reward and judge queries over test views."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmill.catalog import query
from trailmill.operators import rewards as W
from trailmill.operators.rule_reward import rewarded
from trailmill.plans.views import jround_sql as R
from trailmill.plans.views import stable_sql as S
from trailmill.sources.tables import table


def _online(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("run_id"), (k % 5).alias("n_documents"), F.when(k % 3 == 0, "GROUNDED").when(k % 3 == 1, "PARTIAL").otherwise("NONE").alias("grounding"), F.when(k % 7 == 0, None).otherwise(k % 2 == 0).alias("sufficient"),
        (F.col("o_totalprice") / 400000).alias("task"), (k % 12).alias("model_calls"), (k % 3).alias("follow_ups"), F.when(k % 4 == 0, None).otherwise(k % 5 + 1).alias("rating"), (k % 4).alias("specialists"), (k % 2).alias("specialist_ok"), ((k % 10) / 10.0).alias("process"),
    )


@query(
    "online_reward",
    f"""WITH v AS (SELECT o_orderkey AS run_id, o_orderkey AS k, least(1.0::DOUBLE, o_orderkey % 5 / 2.0::DOUBLE) AS a, CASE o_orderkey % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS g, CASE WHEN o_orderkey % 7 = 0 THEN 0.0::DOUBLE WHEN o_orderkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS e,
  least(1.0::DOUBLE, greatest(0, o_totalprice / 400000)) AS t, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - 0.08::DOUBLE * greatest(0, o_orderkey % 12 - 4) - 0.12::DOUBLE * (o_orderkey % 3))) AS f, CASE WHEN o_orderkey % 4 = 0 THEN 0.5::DOUBLE ELSE (o_orderkey % 5) / 4.0::DOUBLE END AS r FROM orders),
b AS (SELECT *, 0.2::DOUBLE * a + 0.25::DOUBLE * g + 0.15::DOUBLE * e + 0.2::DOUBLE * t + 0.1::DOUBLE * f + 0.1::DOUBLE * r AS base, 0.65::DOUBLE * (k % 10) / 10.0::DOUBLE + 0.35::DOUBLE * (k % 2) / greatest(k % 4, 1) AS c FROM v)
SELECT run_id, {S("CASE WHEN k % 4 > 0 THEN 0.9::DOUBLE * base + 0.1::DOUBLE * c ELSE base END", 6)} AS total FROM b""",
)
def online_reward(spark, sf_dir):
    return W.online_reward(_online(spark, sf_dir)).select("run_id", "total")


_TURNS = "p AS (SELECT a.conv_id, a.turn, a.text AS answer, b.text AS solution FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 WHERE a.role = 'assistant')"


def _pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    a, b = c.where("role = 'assistant'").alias("a"), c.alias("b")
    return a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn") == F.col("b.turn") + 1)).select("a.conv_id", "a.turn", F.col("a.text").alias("answer"), F.col("b.text").alias("solution"))


@query(
    "text_f1",
    f"""WITH {_TURNS}, x AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(answer), '[a-z0-9]+')) AS w, 1 AS a, 0 AS b FROM p UNION ALL SELECT conv_id, turn, unnest(regexp_extract_all(lower(solution), '[a-z0-9]+')), 0, 1 FROM p),
c AS (SELECT conv_id, turn, w, sum(a) AS a, sum(b) AS b FROM x GROUP BY 1, 2, 3), s AS (SELECT conv_id, turn, sum(least(a, b)) AS k, sum(a) AS na, sum(b) AS nb FROM c GROUP BY 1, 2)
SELECT p.conv_id, p.turn, CASE WHEN k > 0 THEN {R("2 * (k / na::DOUBLE) * (k / nb::DOUBLE) / (k / na::DOUBLE + k / nb::DOUBLE)", 6)} ELSE 0 END AS f1 FROM p LEFT JOIN s ON s.conv_id = p.conv_id AND s.turn = p.turn""",
)
def text_f1(spark, sf_dir):
    from trailmill.functions.numeric import jround

    return _pairs(spark, sf_dir).select("conv_id", "turn", jround(W.token_f1(F.col("answer"), F.col("solution")), 6).alias("f1"))


_WORDS = "regexp_extract_all(lower({0}), '[a-z0-9]{{2,}}')"
_STOP = "['that', 'this', 'with', 'from', 'have']"


@query(
    "rlvr_reward",
    f"""WITH {_TURNS}, t AS (SELECT *, regexp_replace(answer, '^\\s+|\\s+$', '', 'g') AS a, regexp_replace(solution, '^\\s+|\\s+$', '', 'g') AS s FROM p),
x AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(a), '[a-z0-9]+')) AS w, 1 AS a, 0 AS b FROM t UNION ALL SELECT conv_id, turn, unnest(regexp_extract_all(lower(s), '[a-z0-9]+')), 0, 1 FROM t),
c AS (SELECT conv_id, turn, w, sum(a) AS a, sum(b) AS b FROM x GROUP BY 1, 2, 3), f AS (SELECT conv_id, turn, sum(least(a, b)) AS k, sum(a) AS na, sum(b) AS nb FROM c GROUP BY 1, 2),
l AS (SELECT t.*, k, na, nb, list_filter(list_transform(string_split(a, chr(10)), lambda y: trim(regexp_replace(y, '\\s+', ' ', 'g'))), lambda y: length(y) >= 8) AS ls,
  list_filter({_WORDS.format("a")}, lambda y: NOT list_contains({_STOP}, y)) AS ua, {_WORDS.format("s")} AS us FROM t LEFT JOIN f ON f.conv_id = t.conv_id AND f.turn = t.turn),
m AS (SELECT *, CASE WHEN k > 0 THEN 2 * (k / na::DOUBLE) * (k / nb::DOUBLE) / (k / na::DOUBLE + k / nb::DOUBLE) ELSE 0 END AS f1, CASE WHEN len(ua) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(ua, lambda y: list_contains(us, y))) / len(ua)::DOUBLE END AS g,
  CASE WHEN turn % 4 > 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS ci, (1.0::DOUBLE + CASE WHEN contains(a, 'the') OR contains(a, 'der') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN contains(a, 'Qqq') THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) / 3.0::DOUBLE AS tc,
  CASE WHEN s = '' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS sb, CASE turn % 4 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS rq, CASE conv_id % 4 WHEN 3 THEN 0.0::DOUBLE WHEN 2 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS co,
  1 - 0.15::DOUBLE * greatest(0, conv_id % 6 - 3) - 0.10::DOUBLE * greatest(0, turn % 6 - 3) AS ef, CASE WHEN len(ls) < 2 THEN 0.0::DOUBLE ELSE (len(ls) - len(list_distinct(ls))) / len(ls)::DOUBLE END AS rep FROM l),
h AS (SELECT *, 1 - CASE WHEN rep > 0.35::DOUBLE THEN 0.35::DOUBLE ELSE 0 END - CASE WHEN length(a) >= 100 AND s <> '' AND f1 > 0.94::DOUBLE THEN 0.25::DOUBLE ELSE 0 END AS ah, length(a) BETWEEN 80 AND 6000 AS gate FROM m)
SELECT conv_id, turn, gate, CASE WHEN gate THEN {R("g", 6)} ELSE 0 END AS grounding_quality, CASE WHEN gate THEN {R("tc", 6)} ELSE 0 END AS task_completion_quality,
  CASE WHEN NOT gate THEN 0.0::DOUBLE ELSE {S("(0.10::DOUBLE * f1 + 0.20::DOUBLE * g + 0.10::DOUBLE * ci + 0.20::DOUBLE * tc + 0.10::DOUBLE * sb + 0.10::DOUBLE * rq + 0.05::DOUBLE * co + 0.05::DOUBLE * ef + 0.10::DOUBLE * ah) * (0.5::DOUBLE + 0.5::DOUBLE * ah)", 6)} END AS total,
  CASE WHEN a = '' THEN 'empty_answer,answer_too_short' WHEN length(a) < 80 THEN 'answer_too_short' WHEN length(a) > 6000 THEN 'answer_too_long' ELSE
    array_to_string(list_filter([CASE WHEN turn % 4 > 0 AND ci = 0 THEN 'missing_or_invalid_citation' END, CASE WHEN tc < 0.6::DOUBLE THEN 'instruction_contract_incomplete' END, CASE WHEN ah < 0.6::DOUBLE THEN 'possible_reward_hacking' END], lambda y: y IS NOT NULL), ',') END AS violations FROM h""",
)
def rlvr_reward(spark, sf_dir):
    k, t = F.col("conv_id"), F.col("turn")
    none = lambda kind: F.lit(None).cast(kind)
    rows = _pairs(spark, sf_dir).withColumns({
        "question": F.col("solution"), "context": F.col("solution"), "documents": (t % 4).cast("int"), "retrieval_calls": (k % 6).cast("int"), "planned_queries": (t % 6).cast("int"), "follow_ups": (k % 4).cast("int"),
        "minimum_chars": none("int"), "maximum_chars": none("int"), "citation_required": none("boolean"), "required_concepts": F.array(F.lit("the|der")), "forbidden_phrases": F.array(F.lit("Qqq")), "no_follow_up": none("boolean"), "minimum_action_items": none("int"), "must_mark_assumptions": none("boolean"),
    })
    return rewarded(rows).select("conv_id", "turn", "gate", "grounding_quality", "task_completion_quality", "total", F.array_join("violations", ",").alias("violations"))


def _runs(spark, sf_dir):
    k = F.col("o_orderkey")
    some = lambda c: F.when(k % 23 != 0, c)
    return table(spark, sf_dir, "orders").select(
        k.alias("run_id"), F.when(k % 11 == 0, "FAILED").otherwise("COMPLETED").alias("status"), F.lit(None).cast("string").alias("error"), F.col("o_orderpriority").alias("question"), F.when(k % 13 == 0, " ").otherwise("x").alias("answer"),
        F.when(k % 17 == 0, k % 5 + 1).alias("rating"), (k % 19 == 0).alias("evaluation_only"), some((k % 5) / 4.0).alias("retrieval"), some(F.when(k % 9 == 0, 0.6).otherwise(1.0)).alias("grounding"),
        some(F.lit(0.5)).alias("convergence"), some((k % 7) / 6.0).alias("task"), some(F.lit(1.0)).alias("collaboration"), some(1 - (k % 4) / 4.0).alias("efficiency"),
    )


def _scores(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("seq"), F.concat(F.lit(" j"), (F.col("l_linenumber") % 2).cast("string")).alias("judge"), (F.col("l_linenumber") % 5).alias("dimension"), (F.col("l_discount") * 10 + 0.2).alias("score"), (1.02 - F.col("l_tax") * 2).alias("confidence"))


_ASSESSED = f"""r0 AS (SELECT o_orderkey AS run_id, o_orderkey AS k, CASE WHEN k % 9 = 0 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS gr FROM orders),
r AS (SELECT *, CASE WHEN k % 23 = 0 THEN 0 ELSE least(1, 0.20::DOUBLE * (k % 5) / 4.0::DOUBLE + 0.25::DOUBLE * gr + 0.15::DOUBLE * 0.5::DOUBLE + 0.25::DOUBLE * (k % 7) / 6.0::DOUBLE + 0.05::DOUBLE + 0.10::DOUBLE * (1 - (k % 4) / 4.0::DOUBLE)) END AS verifier,
  array_to_string(list_filter([CASE WHEN k % 11 = 0 THEN 'not_completed' END, CASE WHEN k % 13 = 0 THEN 'blank_text' END, CASE WHEN k % 23 = 0 THEN 'no_reward' END, CASE WHEN k % 23 <> 0 AND gr < 0.7::DOUBLE THEN 'grounding' END, CASE WHEN k % 23 <> 0 AND k % 7 = 0 THEN 'task' END], lambda y: y IS NOT NULL), ',') AS reasons FROM r0),
one AS (SELECT l_orderkey AS run_id, l_linenumber % 2 AS judge, l_linenumber % 5 AS dimension, min((l_linenumber, l_discount * 10 + 0.2::DOUBLE, 1.02::DOUBLE - l_tax * 2)) AS s FROM lineitem GROUP BY 1, 2, 3),
o AS (SELECT run_id, dimension, least(1, greatest(0, s[2])) AS x, least(1, greatest(0, s[3])) AS c FROM one), g AS (SELECT run_id, sum(x * greatest(0.05::DOUBLE, c)) / sum(greatest(0.05::DOUBLE, c)) AS ai, avg(c) AS mc, count(*) AS n, count(DISTINCT dimension) AS dims FROM o GROUP BY 1),
sp AS (SELECT run_id, avg(abs(x - ai)) AS sp FROM o JOIN g USING (run_id) GROUP BY 1), d AS (SELECT r.*, coalesce(ai, 0) AS ai, coalesce(mc, 0) AS mc, coalesce(n, 0) AS n, coalesce(dims, 0) AS dims, CASE WHEN coalesce(n, 0) < 2 THEN 0 ELSE least(1, greatest(0, 1 - 2 * sp)) END AS ag FROM r LEFT JOIN g USING (run_id) LEFT JOIN sp USING (run_id)),
e AS (SELECT *, least(1, greatest(0, mc * ag * least(1, dims / 4.0::DOUBLE))) AS sure, {S("0.45::DOUBLE * verifier + 0.55::DOUBLE * ai", 4)} AS total FROM d),
a AS (SELECT run_id, n, verifier, ai, total, sure, ag, reasons, CASE WHEN k % 19 = 0 THEN ['EVALUATION_ONLY', 'EXCLUDED'] WHEN reasons <> '' THEN ['REJECTED', 'EXCLUDED'] WHEN k % 17 = 0 THEN ['HUMAN_LABELED', CASE WHEN k % 5 + 1 >= 4 THEN 'POSITIVE' WHEN k % 5 + 1 <= 2 THEN 'NEGATIVE' ELSE 'HOLDOUT' END]
  WHEN n < 4 OR {R("ag", 10)} < 0.7::DOUBLE OR {R("sure", 10)} < 0.72::DOUBLE THEN ['UNLABELED', 'HOLDOUT'] WHEN total >= 0.75::DOUBLE THEN ['PSEUDO_LABELED', 'POSITIVE'] WHEN total <= 0.35::DOUBLE THEN ['PSEUDO_LABELED', 'NEGATIVE'] ELSE ['UNLABELED', 'HOLDOUT'] END AS rung FROM e),
jd AS (SELECT run_id, rung[1] AS label, rung[2] AS decision, {S("verifier", 4)} AS verifier, {S("ai", 4)} AS ai, total, CASE WHEN rung[1] = 'HUMAN_LABELED' THEN 1.0::DOUBLE ELSE {S("sure", 4)} END AS confidence, {S("ag", 4)} AS agreement, n, reasons FROM a)"""


@query("judge_assessments", f"WITH {_ASSESSED} SELECT * FROM jd")
def judge_assessments(spark, sf_dir):
    return W.assessed(_runs(spark, sf_dir), _scores(spark, sf_dir))


@query("alignment_metrics", f"WITH {_ASSESSED} SELECT label, decision, count(*) AS n, {S('avg(total)', 6)} AS avg_total, {R('coalesce(avg(CASE WHEN agreement < 0.7::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (n >= 2), 0)', 6)} AS disagreement FROM jd GROUP BY 1, 2")
def alignment_metrics(spark, sf_dir):
    return W.alignment_metrics(W.assessed(_runs(spark, sf_dir), _scores(spark, sf_dir)))


@query(
    "ridge_calibration",
    f"""WITH v AS (SELECT l_discount AS x1, l_tax AS x2, l_extendedprice / 100000 AS y FROM lineitem), s AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, covar_pop(x1, x2) AS s12, var_pop(x1) + 0.1::DOUBLE / count(*) AS a11, var_pop(x2) + 0.1::DOUBLE / count(*) AS a22, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y, count(*) AS n FROM v),
b AS (SELECT *, (s1y * a22 - s2y * s12) / (a11 * a22 - s12 * s12) AS b1, (s2y * a11 - s1y * s12) / (a11 * a22 - s12 * s12) AS b2 FROM s), c AS (SELECT n, my - b1 * m1 - b2 * m2 AS b0, b1, b2 FROM b)
SELECT max(n) AS n, {R("max(b0)", 5)} AS b0, {R("max(b1)", 5)} AS b1, {R("max(b2)", 5)} AS b2, {R("avg(abs(y - b0 - b1 * x1 - b2 * x2))", 5)} AS mae FROM v, c""",
)
def ridge_calibration(spark, sf_dir):
    return W.ridge(table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("x1"), F.col("l_tax").alias("x2"), (F.col("l_extendedprice") / 100000).alias("y")))


@query(
    "draft_or_revision",
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN floor(l_discount * 100) * 100000 + floor(l_quantity * 1000) > floor(l_tax * 100) * 100000 + floor(l_linenumber * 1000) THEN 'revised' ELSE 'draft' END AS winner FROM lineitem",
)
def draft_or_revision(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_discount").alias("revised_score"), F.col("l_quantity").alias("revised_coverage"), F.col("l_tax").alias("draft_score"), F.col("l_linenumber").alias("draft_coverage"))
    return W.chosen_revision(rows).select("l_orderkey", "l_linenumber", "l_partkey", "winner")


@query(
    "judge_cost_bound",
    f"WITH v AS (SELECT count(*) AS n, CAST(sum(ceil((n_chars + length(lang) + 600) * 1.25::DOUBLE)) * 4 AS BIGINT) AS i FROM documents) SELECT n, n * 4 AS calls, i AS input_tokens, n * 800 AS output_tokens, {R('(i * 0.3::DOUBLE + n * 800 * 0.6::DOUBLE) / 1e6::DOUBLE', 8)} AS cost FROM v",
)
def judge_cost_bound(spark, sf_dir):
    return W.cost_bound(table(spark, sf_dir, "documents").select(F.length("lang").alias("question_chars"), F.col("n_chars").alias("answer_chars")), 0.3, 0.6)


@query(
    "process_reward",
    f"SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 0.0::DOUBLE ELSE {R('least(1, CASE WHEN length(trim(text)) > 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN contains(text, chr(10)) THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN turn BETWEEN 1 AND 4 THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END + 0.2::DOUBLE * least(1, turn / 5.0::DOUBLE))', 6)} END AS process FROM conversations",
)
def process_reward(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", (F.col("turn") % 5 != 4).alias("success"), F.col("text").alias("findings"), F.when(F.col("text").contains("\n"), F.col("text")).alias("recommendations"), F.array("turn", "turn").alias("sources"), F.lit(4).alias("max_source"), (F.col("turn") / 5.0).alias("confidence")
    )
    return W.process_reward(rows).select("conv_id", "turn", "process")


_DOMAINS = {"conflict": ["the", "der"], "growth": ["ing", "ung"], "family": ["mente", "ción"], "trust": ["eux"]}


@query(
    "question_router",
    "WITH v AS (SELECT conv_id, turn, "
    + "list_filter(["
    + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{k}')" for k in ks) + f" THEN '{d}' END" for d, ks in _DOMAINS.items())
    + "], lambda x: x IS NOT NULL) AS ds, contains(lower(text), chr(10)) AS st, length(text) >= 70 AS lo FROM conversations WHERE role = 'user') "
    + f"SELECT conv_id, turn, {R('least(1, 0.18::DOUBLE * len(ds) + 0.25::DOUBLE * CAST(st AS INTEGER) + 0.15::DOUBLE * CAST(lo AS INTEGER))', 6)} AS complexity, CASE WHEN len(ds) >= 2 THEN 'ADAPTIVE_MULTI_AGENT' ELSE 'SINGLE_AGENT' END AS mode, array_to_string(list_sort(ds), '+') || '|structured=' || CAST(st AS VARCHAR) || '|long=' || CAST(lo AS VARCHAR) AS bucket FROM v",
)
def question_router(spark, sf_dir):
    q = table(spark, sf_dir, "conversations").where("role = 'user'")
    return W.routed(q, _DOMAINS, structured="\n").select("conv_id", "turn", "complexity", "mode", "bucket")
