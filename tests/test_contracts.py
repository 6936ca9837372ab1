"""Literal cases of answer contracts."""

import pytest
from pyspark.sql import functions as F

from trailmill.operators import contracts as C


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def strings(*values):
    return F.array(*[F.lit(v) for v in values])


def ids(spark, terms, answer, context=""):
    return [x.id for x in value(spark, C.missing(terms, F.lit(answer).cast("string"), F.lit(context).cast("string")))]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a [来源 1，2, 2] b", "a [来源 1][来源 2] b"),
        ("见参考来源：[3、04]。", "见[来源 3][来源 4]。"),
        ("x（依据来源 1，2）", "x[来源 1][来源 2]"),
        ("x 来源 7。", "x [来源 7]。"),
        ("[来源 12] 与 [来源3]", "[来源 12] 与 [来源3]"),
        ("", ""),
        (None, None),
    ],
)
def test_citation_forms(spark, text, want):
    assert value(spark, C.canonical_citations(F.lit(text).cast("string"))) == want


def test_citations_against_context(spark):
    ok = lambda a, c: value(spark, C.citations_satisfied(F.lit(a), F.lit(c)))
    assert ok("x", "") and ok("x [来源 1]", "[来源 1 | a]") and not ok("x", "[来源 1 | a]") and not ok("x [来源 1][来源 2]", "[来源 1 | a]")


def test_inferred_and_merged(spark):
    given = C.contract(strings("独立"), cite=F.lit(True), actions=F.lit(0))
    both = value(spark, C.merged(given, F.lit("不要追问，请给十五分钟话术和三项行动。")))
    assert both.concepts == ["独立", "15分钟|十五分钟", "话术|可以这样说"] and both.direct and both.cite
    assert (both.actions, both.least_chars, both.most_chars) == (3, 140, 1600)
    week = value(spark, C.inferred(F.lit("七天小计划")))
    assert (week.actions, week.least_chars, week.most_chars) == (7, 320, 2400)
    assert value(spark, C.inferred(F.lit(None).cast("string"))).concepts == []


def test_items_are_bounded(spark):
    kept = value(spark, C.contract(strings(*[f" c{i % 30} " for i in range(60)], " "))).concepts
    assert kept == [f"c{i}" for i in range(24)]
    with pytest.raises(Exception, match="too long"):
        value(spark, C.contract(strings("长" * 81)))


def test_inline_steps(spark):
    terms = C.contract(strings("三项|3项|三个|3个"), least_chars=F.lit(1), most_chars=F.lit(1600), actions=F.lit(3))
    text = "行动项：1. 了解喜好；2. 准备惊喜；3. 复盘效果。"
    assert value(spark, C.structured(F.lit(text), terms)) == "行动项：\n1. 了解喜好；\n2. 准备惊喜；\n3. 复盘效果。"
    assert ids(spark, terms, text) == []
    one = C.contract(least_chars=F.lit(1), most_chars=F.lit(1600), actions=F.lit(1))
    assert value(spark, C.structured(F.lit("建议比例：1.5%，再调整。"), one)) == "建议比例：1.5%，再调整。" and ids(spark, one, "建议比例：1.5%，再调整。") == ["action-items"]
    assert value(spark, C.structured(F.lit("做到 社交|沟通 即可"), C.contract(strings("社交|沟通")))) == "做到 社交 即可"


def test_every_missing_requirement(spark):
    terms = C.contract(strings("社交|沟通", "锻炼|健康"), strings("推荐课程"), F.lit(1), F.lit(1600), F.lit(False), F.lit(True), F.lit(True), F.lit(3))
    assert ids(spark, terms, "推荐课程。请补充更多。") == ["concept-01", "concept-02", "forbidden-01", "no-follow-up", "action-items", "assumptions"]
    assert ids(spark, terms, None)[0] == "length-minimum"
    cite = C.contract(cite=F.lit(True))
    assert ids(spark, cite, "x") == ["citation-evidence"] and ids(spark, cite, "x", "[来源 1 | a]") == ["citation-format"] and ids(spark, cite, "x [来源 1]", "[来源 1 | a]") == []


def test_concepts_by_alias_day_and_count(spark):
    assert ids(spark, C.contract(strings("情绪管理", "周一|星期一", "周日|星期日")), "正视情绪，第1天开始，第七天结束") == []
    assert ids(spark, C.contract(strings("三项|3项")), "1. 一\n2. 二") == ["concept-01"]
    assert ids(spark, C.contract(strings("三项|3项")), "- 一\n- 二\n- 三") == []
    assert value(spark, C.observed_actions(F.lit("2. 二\n3. 三"))) == 0


def test_audit(spark):
    found = "array<struct<id:string,requirement:string>>"
    rows = spark.createDataFrame([([("a", ""), ("b", "")], [("b", "")]), ([("b", "")], []), ([], [("a", "")])], f"before {found}, after {found}")
    assert sorted(tuple(r) for r in C.audited(rows, "before", "after").collect()) == [("a", 1, 1, 0), ("b", 2, 1, 1)]
    assert C.audited(rows.limit(0), "before", "after").collect() == []


@pytest.mark.parametrize("numbers", [{"least_chars": -1}, {"least_chars": 8001}, {"most_chars": 0}, {"most_chars": 9000}, {"actions": -4}, {"actions": 21}, {"least_chars": 5, "most_chars": 4}])
def test_numbers_out_of_range_are_refused(spark, numbers):
    with pytest.raises(Exception, match="contract's"):
        value(spark, C.contract(**{k: F.lit(v) for k, v in numbers.items()}))


def test_numbers_at_their_bounds(spark):
    got = value(spark, C.contract(least_chars=F.lit(0), most_chars=F.lit(8000), actions=F.lit(20)))
    assert (got.least_chars, got.most_chars, got.actions) == (0, 8000, 20)
    assert value(spark, C.contract()).most_chars is None
