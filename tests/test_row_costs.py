"""Queries whose rows cost far more than their bytes: each text worked out once, and rows dealt over the cores."""

import pytest

from trailmill import registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "most"), [("contract_repair", 60), ("contract_audit", 30)])
def test_texts_are_bound_and_rows_dealt(spark, name, most):
    df = registry.QUERIES[name](spark, SMALL)
    plan = df._jdf.queryExecution()
    # In contract_repair the answer was rewritten anew for each word that was looked for in it: 263 replacements a row.
    assert plan.optimizedPlan().toString().count("regexp_replace(") <= most
    # One split of a small file was one task, whatever its rows cost.
    assert "REPARTITION_BY_NUM" in plan.executedPlan().toString()


def test_marks_that_gate_patterns(spark):
    from pyspark.sql import functions as F

    from trailmill.operators import contracts as C

    texts = ["1. a\n2. b\n3. c", "2. b\n3. c", "1. a 3. c", "- a\n* b", "周一周二", "", "10. z", "".join(f"{i}. x\n" for i in range(1, 11)), None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(C.observed_actions(F.col("t")).alias("n"))
    assert [r.n for r in df.collect()][:-1] == [3, 0, 1, 2, 2, 0, 0, 10]
    inline = spark.createDataFrame([("步骤：1. 甲；2. 乙",), ("没有",)], "t string").select(C.structured(F.col("t"), C.contract(actions=F.lit(2))).alias("s"))
    assert [r.s for r in inline.collect()] == ["步骤：\n1. 甲；\n2. 乙", "没有"]
