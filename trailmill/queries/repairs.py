"""Rendering of made repairs, one an order: with and without evidence, actions and assumptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmill.catalog import query
from trailmill.operators import contracts as C
from trailmill.operators import repairs as R
from trailmill.plans.spreading import spread
from trailmill.sources.tables import table

_ANSWERS = ["建议从双方可接受的小事开始。", "用心对待彼此。\n", " ", "保持舒适的距离，基于现有信息。"]
_FIRST = ["提前了解偏好并记录对方真正重视的小事。", "用心", "先听对方说完，再给出自己的想法。"]
_SECOND = ["先确认双方可接受的范围，不施加压力。", ""]
_NAMES = ["concept-02", "边界|舒适", "覆盖概念：边界|舒适", "concept-09"]
_ACTIONS = [["1. 检查个人卫生。", "2、联系一位朋友。", "3) 安排十分钟快走。"], ["行动", "二"], ["检查预算。", "1. 检查预算。", "记录结果。"], ["记录结果。", "检查预算。", "约定时间。", "再多一项。"]]
_ASSUMED = ["目前没有完整预算信息，先按零额外支出设计。", "略"]
_RENDERED = ["检查个人卫生。|联系一位朋友。|安排十分钟快走。", "", "", "记录结果。|检查预算。|约定时间。"]


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("\n", "' || chr(10) || '") + "'" for v in values) + "]"


_STEPS = "array_to_string(list_transform(string_split(acts, '|'), lambda a, i: chr(10) || i || '. ' || a), '')"


@query(
    "contract_repair",
    f"""WITH m AS (SELECT o_orderkey AS k, trim({_sql_list(_ANSWERS)}[o_custkey % 4 + 1], ' ' || chr(10)) AS t0, {_sql_list(_FIRST)}[o_orderkey % 3 + 1] AS e1, CASE WHEN o_custkey % 5 < 4 AND o_orderkey % 4 < 3 THEN {_sql_list(_SECOND)}[o_custkey % 2 + 1] ELSE '' END AS e2,
  {_sql_list(_RENDERED)}[o_orderkey % 4 + 1] AS acts, {_sql_list(_ASSUMED)}[o_custkey % 3 % 2 + 1] AS asm FROM orders),
a AS (SELECT *, contains(t0, '用心') OR length(e1) < 8 AS met1, CASE WHEN contains(t0, '用心') OR length(e1) < 8 THEN t0 ELSE t0 || chr(10) || chr(10) || '**用心**：' || e1 END AS t1 FROM m WHERE t0 <> ''),
b AS (SELECT *, contains(t1, '边界') OR contains(t1, '舒适') OR length(e2) < 8 AS met2, CASE WHEN contains(t1, '边界') OR contains(t1, '舒适') OR length(e2) < 8 THEN t1 ELSE t1 || chr(10) || chr(10) || '**边界**：' || e2 END AS t2 FROM a),
c AS (SELECT *, CASE WHEN acts = '' THEN t2 ELSE t2 || chr(10) || chr(10) || '**行动项**' || {_STEPS} END AS t3 FROM b),
d AS (SELECT *, NOT contains(t3, '基于现有') AND length(asm) >= 8 AS assumed, CASE WHEN contains(t3, '基于现有') OR length(asm) < 8 THEN t3 ELSE t3 || chr(10) || chr(10) || '**合理假设**：' || asm END AS t4 FROM c),
r AS (SELECT k, t4 AS answer, CAST(NOT met1 AS INTEGER) + CAST(NOT met2 AS INTEGER) AS sections, CASE WHEN acts = '' THEN 0 ELSE 3 END AS actions, assumed FROM d UNION ALL SELECT k, '', 0, 0, false FROM m WHERE t0 = '')
SELECT k AS run_id, answer, sections > 0 OR actions > 0 OR assumed AS accepted, CAST(sections AS INTEGER) AS sections, CAST(actions AS INTEGER) AS actions, assumed, array_to_string(list_filter([CASE WHEN answer = '' THEN 'length-minimum' END, CASE WHEN NOT contains(answer, '用心') THEN 'concept-01' END, CASE WHEN NOT contains(answer, '边界') AND NOT contains(answer, '舒适') THEN 'concept-02' END,
  CASE WHEN actions = 0 THEN 'action-items' END, CASE WHEN NOT contains(answer, '假设') AND NOT contains(answer, '基于现有') THEN 'assumptions' END], lambda x: x IS NOT NULL), ',') AS missing_ids FROM r""",
)
def contract_repair(spark, sf_dir):
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda values, i: F.element_at(F.array(*values), (i + 1).cast("int"))
    texts = lambda values: [F.lit(v) for v in values]
    lists = [F.array(*texts(v)) for v in _ACTIONS]
    second = F.when(c % 5 < 4, pick(texts(_SECOND), c % 2)).otherwise(F.lit(""))
    evidence = F.array(F.struct(F.lit("concept-01").alias("id"), pick(texts(_FIRST), n % 3).alias("content")), F.struct(pick(texts(_NAMES), n % 4).alias("id"), second.alias("content")))
    repair = F.struct(pick(texts(_ANSWERS), c % 4).alias("answer"), evidence.alias("evidence"), pick(lists, n % 4).alias("actions"), pick(texts(_ASSUMED), c % 3 % 2).alias("assumptions"))
    terms = C.contract(F.array(F.lit("用心"), F.lit("边界|舒适")), None, F.lit(1), F.lit(1600), F.lit(False), F.lit(False), F.lit(True), F.lit(3))
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    rows = orders.select(n.alias("run_id"), R.rendered(terms, repair, F.lit("")).alias("r"))
    return rows.select("run_id", "r.answer", "r.accepted", "r.sections", "r.actions", "r.assumed", F.array_join("r.missing.id", ",").alias("missing_ids"))
