"""Literal cases of the repair renderer."""

from pyspark.sql import functions as F

from trailmill.operators import contracts as C
from trailmill.operators import repairs as R


def strings(*values):
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def rendered(spark, terms, answer, evidence=(), actions=(), assumptions="", context=""):
    kind = "answer: string, evidence: array<struct<id: string, content: string>>, actions: array<string>, assumptions: string"
    frame = spark.createDataFrame([((answer, list(evidence), list(actions), assumptions), context)], f"repair struct<{kind}>, context string")
    return frame.select(R.rendered(terms, F.col("repair"), F.col("context")).alias("r")).first()["r"]


def terms(concepts=(), forbidden=(), cite=False, assume=False, actions=0):
    return C.contract(strings(*concepts), strings(*forbidden), F.lit(1), F.lit(1600), F.lit(cite), F.lit(False), F.lit(assume), F.lit(actions))


def test_sections_and_numbered_actions(spark):
    r = rendered(
        spark, terms(["用心", "边界|舒适"], actions=3), "建议从双方可接受的小事开始。 \n",
        [("concept-01", "提前了解偏好并记录对方真正重视的小事。"), ("concept-02", "先确认双方可接受的范围，不以惊喜为名施加压力。")],
        ["1. 询问近期偏好并记下答案。", "2、共同确认预算和时间范围。", "3) 完成后询问感受并记录调整点。", "第四个行动不需要"],
    )
    assert r.answer == (
        "建议从双方可接受的小事开始。\n\n**用心**：提前了解偏好并记录对方真正重视的小事。\n\n**边界**：先确认双方可接受的范围，不以惊喜为名施加压力。"
        "\n\n**行动项**\n1. 询问近期偏好并记下答案。\n2. 共同确认预算和时间范围。\n3. 完成后询问感受并记录调整点。"
    )
    assert (r.accepted, r.sections, r.actions, r.assumed, r.missing) == (True, 2, 3, False, [])


def test_bare_keywords_and_too_few_actions_add_nothing(spark):
    r = rendered(spark, terms(["社交圈"], actions=3), "建议从小目标开始。", [("concept-01", "社交圈")], ["行动一", "行动二"])
    assert (r.answer, r.accepted) == ("建议从小目标开始。", False)
    assert [m.id for m in r.missing] == ["concept-01", "action-items"]
    # Actions that are the same once their numbers are gone are one.
    assert rendered(spark, terms(actions=2), "好。", [], ["1. 检查预算表", "2. 检查预算表"]).actions == 0


def test_forbidden_phrases_stay_and_citations_are_not_invented(spark):
    r = rendered(spark, terms(["独立"], ["推荐课程"], cite=True), "推荐课程可以快速解决问题。", [("独立", "保留可自主安排的学习时间，并与家庭责任协调。")], context="[来源 1 | 已婚篇.md]\n应兼顾个人成长和家庭责任。")
    assert "推荐课程" in r.answer and "[来源 1]" not in r.answer and "**独立**：保留" in r.answer
    assert {m.requirement for m in r.missing} == {"删除禁用短语：推荐课程", "使用有效的 [来源 n] 单编号引用"}


def test_assumptions_need_substance(spark):
    r = rendered(spark, terms(assume=True), "可以先执行低风险方案。", assumptions="目前没有完整预算信息，先按零额外支出设计。")
    assert r.assumed and r.accepted and "**合理假设**：目前没有完整预算信息" in r.answer and not r.missing
    assert not rendered(spark, terms(assume=True), "可以先执行低风险方案。", assumptions=" 略 ").assumed


def test_a_section_may_meet_what_comes_after(spark):
    # The first section names the second concept, so that the second adds nothing.
    r = rendered(spark, terms(["用心", "边界|舒适"]), "好。", [("覆盖概念：用心", "用心了解对方觉得舒适的范围。"), ("边界|舒适", "先确认双方可接受的范围再行动。")])
    assert r.sections == 1 and r.answer == "好。\n\n**用心**：用心了解对方觉得舒适的范围。" and not r.missing


def test_blank_null_and_oversized(spark):
    for answer in (None, "", " \n\t"):
        r = rendered(spark, terms(["独立"]), answer, [("concept-01", "保留可自主安排的学习时间。")])
        assert (r.answer, r.accepted, r.sections) == ("", False, 0) and [m.id for m in r.missing][-1:] == ["concept-01"]
    big = spark.createDataFrame([(("答" * 8100, [("concept-01", "证" * 1700), ("  ", "x" * 20)], ["行动" * 900, "行动" * 900, " "], "假" * 1700),)], "repair struct<answer: string, evidence: array<struct<id: string, content: string>>, actions: array<string>, assumptions: string>")
    b = big.select(R.bounded(F.col("repair")).alias("b")).first()["b"]
    assert (len(b.answer), len(b.evidence), len(b.evidence[0].content), [len(a) for a in b.actions], len(b.assumptions)) == (8000, 1, 1600, [1600], 1600)
