"""Literal cases of the choice between a draft and its revision."""

import pytest
from pyspark.sql import functions as F

from trailmill.operators import contracts as C
from trailmill.operators import revisions as V

LONG = "双方先说清楚各自的感受，再一起商量怎样安排。" * 8
CONTEXT = "[来源 1 | a.md]\n双方先说清楚各自的感受。"


def chosen(spark, question, context, draft, revised, given=None):
    frame = spark.createDataFrame([(question, context, draft, revised)], "q string, c string, d string, r string")
    return frame.select(V.chosen(*map(F.col, "qcdr"), given).alias("v")).first()["v"]


def test_a_tie_keeps_the_draft(spark):
    got = chosen(spark, "怎么办", "", LONG, LONG)
    assert (got.winner, got.answer, got.draft_score) == ("DRAFT", LONG, got.revised_score)
    # Nothing is missed, no source is there to cite, the length is right, and no further demand is made.
    assert got.draft_score == (20 + 4 + 3 + 6 + 2) * 100_000


def test_a_better_revision_wins_and_citations_have_one_form(spark):
    got = chosen(spark, "怎么办", CONTEXT, LONG, LONG + "（参考来源：1）")
    assert got.winner == "REVISED" and got.answer.endswith("[来源 1]")
    # The draft misses the citation: no pass, five points less, and none of the four for citing.
    assert got.revised_score // 100_000 - got.draft_score // 100_000 in (28, 29, 30)
    assert chosen(spark, "怎么办", CONTEXT, LONG + "[来源 1]", LONG + "[来源 7]").winner == "DRAFT"


@pytest.mark.parametrize(
    ("question", "bad", "points"),
    [("直接给答案", "请补充更多。", 1 + 5 + 20), ("请协调一下", "", 1), ("不要编造课程或案例", "推荐课程。", 2 + 5 + 20), ("请复盘", "", 1 + 5 + 20)],
)
def test_demands_of_the_question(spark, question, bad, points):
    plain = "先说清楚感受，再商量怎样安排，并留出时间。" * 8
    good = {"请协调一下": "协调", "请复盘": "复盘"}.get(question, "好。")
    got = chosen(spark, question, "", plain + bad, plain + good)
    assert got.winner == "REVISED" and (got.revised_score - got.draft_score) / 100_000 == points


def test_blank_texts(spark):
    got = chosen(spark, None, None, "\n\t", LONG)
    assert (got.winner, got.draft_score) == ("REVISED", -(2**31))
    got = chosen(spark, None, None, None, None)
    assert (got.winner, got.answer, got.revised_score) == ("DRAFT", "", -(2**31))


def test_nearness_to_the_context_breaks_ties(spark):
    # All else equal, the text that says what the context says is better, by less than a point.
    far = "完全不同的话题与这里没有关系，只是用来占据篇幅。" * 7
    got = chosen(spark, "怎么办", "双方先说清楚各自的感受，再一起商量怎样安排。", far, LONG)
    assert got.winner == "REVISED" and 0 < got.revised_score - got.draft_score < 30_001


def test_a_given_contract_counts_with_the_questions(spark):
    given = C.contract(F.array(F.lit("边界")), None, F.lit(1), F.lit(1600), F.lit(False), F.lit(False), F.lit(False), F.lit(0))
    got = chosen(spark, "请复盘", "", LONG + "复盘", LONG + "复盘，边界", given)
    assert got.winner == "REVISED" and (got.revised_score - got.draft_score) == 25 * 100_000
