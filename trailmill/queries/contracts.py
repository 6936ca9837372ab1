"""Contract checks and their audit over made answers, one an order."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmill.catalog import query
from trailmill.operators import contracts as C
from trailmill.plans.spreading import spread
from trailmill.sources.tables import table

_QUESTIONS = ["请给十五分钟话术", "给我七天小计划，标明假设", "不要追问，请给三项检查清单", "不要编造课程或案例，请复盘", "怎么办"]
_CITED = [("（参考来源：1，2）", "[来源 1][来源 2]"), ("[来源 1]", "[来源 1]"), ("来源：[3]", "[来源 3]"), ("", "")]
_CONTEXTS = ["", "[来源 1 | a.md]\n[来源 2 | b.md]", "[来源 3 | c.md]"]
_STEPS, _WEEK, _SAY, _ASK, _NOW = "\n1. 倾听。\n2. 表达。\n3. 安排。", "周一散步，星期日总结。", "可以这样说：15分钟就好。", "请补充更多。推荐课程。", "基于现有信息，"


def _answers(spark, sf_dir):
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    part = lambda condition, text: F.when(condition, F.lit(text)).otherwise(F.lit(""))
    draft = F.concat(part(c % 7 < 3, _NOW), part(c % 3 == 0, _WEEK), F.repeat(F.lit("充分的说明。"), (c % 60).cast("int")), part(c % 5 == 0, _ASK))
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    rows = orders.select(n.alias("run_id"), pick(_QUESTIONS, n % 5).alias("question"), pick(_CONTEXTS, n % 3).alias("context"), draft.alias("draft"), pick([x for x, _ in _CITED], n % 4).alias("cited"), c)
    answer = F.concat("draft", part(F.col("o_custkey") % 3 == 1, _SAY), part(F.col("o_custkey") % 2 == 1, _STEPS), C.canonical_citations(F.col("cited")))
    return rows.withColumn("answer", answer).withColumn("contract", C.inferred(F.col("question")))


def _missing_sql(text: str) -> str:
    has = lambda *words: "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"
    days = " + ".join(f"CAST({has(*names)} AS INT)" for names in C.DAYS)
    actions = f"greatest(CASE WHEN {has('3. 安排')} THEN 3 ELSE 0 END, {days})"
    return f"""list_filter([
  CASE WHEN length({text}) < least_chars THEN 'length-minimum' END, CASE WHEN length({text}) > most_chars THEN 'length-maximum' END,
  CASE WHEN k % 3 = 1 AND NOT {has('[来源 1]')} OR k % 3 = 2 AND NOT {has('[来源 3]')} OR k % 3 = 1 AND {has('[来源 3]')} OR k % 3 = 2 AND {has('[来源 1]')} THEN 'citation-format' END,
  CASE k % 5 WHEN 0 THEN CASE WHEN NOT {has('15分钟', '十五分钟')} THEN 'concept-01' END WHEN 1 THEN CASE WHEN NOT {has(*C.DAYS[0])} THEN 'concept-01' END WHEN 3 THEN CASE WHEN NOT {has('复盘', '回顾')} THEN 'concept-01' END END,
  CASE k % 5 WHEN 0 THEN CASE WHEN NOT {has('话术', '可以这样说')} THEN 'concept-02' END WHEN 1 THEN CASE WHEN NOT {has(*C.DAYS[6])} THEN 'concept-02' END END,
  CASE WHEN k % 5 = 3 AND {has('推荐课程')} THEN 'forbidden-01' END, CASE WHEN k % 5 = 2 AND {has('请补充更多')} THEN 'no-follow-up' END,
  CASE WHEN k % 5 = 1 AND {actions} < 7 OR k % 5 = 2 AND {actions} < 3 THEN 'action-items' END,
  CASE WHEN k % 5 = 1 AND NOT {has('假设', '基于目前', '基于现有', '信息不足')} THEN 'assumptions' END], lambda x: x IS NOT NULL)"""


_ANSWERS_SQL = f"""made AS (
  SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 1 THEN 320 ELSE 140 END AS least_chars, CASE WHEN o_orderkey % 5 = 1 THEN 2400 ELSE 1600 END AS most_chars, o_custkey AS c,
    CASE WHEN o_custkey % 7 < 3 THEN '{_NOW}' ELSE '' END || CASE WHEN o_custkey % 3 = 0 THEN '{_WEEK}' ELSE '' END || repeat('充分的说明。', CAST(o_custkey % 60 AS INT)) || CASE WHEN o_custkey % 5 = 0 THEN '{_ASK}' ELSE '' END AS draft,
    CASE o_orderkey % 4 WHEN 0 THEN '{_CITED[0][1]}' WHEN 1 THEN '{_CITED[1][1]}' WHEN 2 THEN '{_CITED[2][1]}' ELSE '' END AS cited FROM orders),
answers AS (SELECT *, draft || CASE WHEN c % 3 = 1 THEN '{_SAY}' ELSE '' END || CASE WHEN c % 2 = 1 THEN '{_STEPS}' ELSE '' END || cited AS answer FROM made)"""


@query("contract_check", f"WITH {_ANSWERS_SQL}, found AS (SELECT k, answer, {_missing_sql('answer')} AS ids FROM answers) SELECT k AS run_id, len(ids) = 0 AS passed, array_to_string(ids, ',') AS missing_ids, length(answer) AS n_chars FROM found")
def contract_check(spark, sf_dir):
    rows = _answers(spark, sf_dir).withColumn("found", C.missing(F.col("contract"), F.col("answer"), F.col("context")))
    return rows.select("run_id", (F.size("found") == 0).alias("passed"), F.array_join("found.id", ",").alias("missing_ids"), F.length("answer").cast("long").alias("n_chars"))


@query(
    "contract_audit",
    f"WITH {_ANSWERS_SQL}, found AS (SELECT {_missing_sql('draft')} AS ids, {_missing_sql('answer')} AS rest FROM answers), each AS (SELECT unnest(ids) AS id, rest FROM found) SELECT id, count(*) AS n_before, count(*) FILTER (NOT list_contains(rest, id)) AS n_resolved, count(*) FILTER (list_contains(rest, id)) AS n_remaining FROM each GROUP BY 1",
)
def contract_audit(spark, sf_dir):
    check = lambda text: C.missing(F.col("contract"), F.col(text), F.col("context"))
    return C.audited(_answers(spark, sf_dir).withColumns({"before": check("draft"), "after": check("answer")}), "before", "after")
