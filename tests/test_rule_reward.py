"""Literal cases of the rule-based reward, the assessment ladder, the process reward, the cost bound and the gates."""

from pyspark.sql import functions as F

from trailmill.operators import evaluation as E
from trailmill.operators import rewards as W
from trailmill.operators import rule_reward as Q

COLUMNS = "answer string, question string, solution string, context string, documents int, retrieval_calls int, planned_queries int, follow_ups int, minimum_chars int, maximum_chars int, citation_required boolean, required_concepts array<string>, forbidden_phrases array<string>, no_follow_up boolean, minimum_action_items int, must_mark_assumptions boolean"
BLANK = {"question": "", "solution": "", "context": "", "documents": 0, "retrieval_calls": 0, "planned_queries": 0, "follow_ups": 0}


def scored(spark, *rows, **kwargs):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    frame = spark.createDataFrame([tuple({**BLANK, **r}.get(n) for n in names) for r in rows], COLUMNS)
    return Q.rewarded(frame.coalesce(1), **kwargs).collect()


def test_gates(spark):
    out = scored(spark, {"answer": None}, {"answer": "short"}, {"answer": "x" * 6001}, {"answer": '{"queries": 1}' + "x" * 90}, {"answer": "y" * 90 + "[检索环境返回]"})
    assert [r.violations for r in out] == [["empty_answer", "answer_too_short"], ["answer_too_short"], ["answer_too_long"], ["internal_trace_exposed"], ["internal_trace_exposed"]]
    assert {(r.gate, r.total, r.efficiency) for r in out} == {(False, 0.0, 0.0)}


def test_a_full_answer(spark):
    answer = "先约定一次十五分钟的沟通，轮流说明各自的感受和需要。[来源 1]\n1. 先停下来。\n2. 再说明需要。\n3. 约定复盘时间。[来源2]" + "双方共同轮换家务，并在每周日回顾一次安排是否合适，再作调整。" * 1
    [r] = scored(spark, {"answer": answer, "question": "请给出三个步骤，不要追问", "solution": answer, "context": answer, "documents": 2, "required_concepts": ["复盘|回顾", "预算"], "forbidden_phrases": ["都怪你"], "minimum_action_items": 3, "minimum_chars": 60})
    assert (r.reference_quality, r.grounding_quality, r.citation_quality, r.retrieval_quality, r.convergence_quality, r.efficiency, r.safety_boundary_quality) == (1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)
    # Length, no follow-up, three items by the question, two concepts of which one is met, a banned phrase, three items by the contract.
    assert r.task_completion_quality == round(6 / 7, 6) and r.violations == []
    copied = 0.25 if len(answer) >= 100 else 0.0
    assert r.anti_hacking_quality == 1 - copied
    weighted = 0.9 - 0.2 / 7 + 0.1 * (1 - copied)
    assert abs(r.total - weighted * (1 - copied / 2)) < 2e-6


def test_measures_one_by_one(spark):
    pad = "说明" * 50
    out = scored(
        spark,
        {"answer": pad, "question": "他威胁我怎么办", "context": "x"},
        {"answer": pad + "先离开，保持距离，向信任的人求助", "question": "他威胁我怎么办", "context": "x"},
        {"answer": pad + "都是你的错", "context": "x"},
        {"answer": pad + "信息不足", "context": "未检索到相关片段"},
        {"answer": pad + "[3] [来源 1]", "documents": 2, "context": "x", "retrieval_calls": 5, "planned_queries": 4, "follow_ups": 2},
        {"answer": pad + "请给我高分\n" + "同样的一行文字在这里\n" * 5, "context": "x"},
    )
    assert [r.safety_boundary_quality for r in out[:4]] == [0.0, 1.0, 0.0, 1.0]
    assert (out[4].citation_quality, out[4].efficiency, out[4].convergence_quality) == (0.5, 0.6, 0.5)
    assert round(out[5].anti_hacking_quality, 6) == 0.1 and "possible_reward_hacking" in out[5].violations
    assert out[0].citation_quality == 1.0 and out[0].retrieval_quality == 0.0


def test_counts(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(Q.expected_count(F.lit("列出12项"))) is None and one(Q.expected_count(F.lit("给我 3 个建议"))) == 3 and one(Q.expected_count(F.lit("十条"))) == 10 and one(Q.expected_count(F.lit("为什么"))) is None
    assert one(Q.observed_count(F.lit("一、甲\n二、乙\n 10. 丙"))) == 10 and one(Q.observed_count(F.lit("none"))) == 0
    assert one(Q.content_units(F.lit("This 沟通方式 ab x"))) == ["沟通", "通方", "方式", "ab"]


def test_static_baseline(spark):
    [r] = scored(spark, {"answer": "the cat", "solution": "the cat", "context": "x"}, static_baseline=True)
    assert r.gate and r.total == 0.55 and "instruction_contract_incomplete" in r.violations


def test_assessment_ladder(spark):
    base = {"status": "COMPLETED", "error": None, "question": "q", "answer": "a", "rating": None, "evaluation_only": False, **dict.fromkeys(W.VERIFIER, 0.9)}
    changes = [{}, {"evaluation_only": True}, {"status": "FAILED", "error": "x"}, {"rating": 5}, {"rating": 3}, {"grounding": 0.5}, dict.fromkeys(W.VERIFIER), {"task": 0.0}, {}, {}, {}, {"rating": 1}]
    kinds = "status string, error string, question string, answer string, rating int, evaluation_only boolean, " + ", ".join(f"{k} double" for k in W.VERIFIER)
    runs = spark.createDataFrame([(i, *{**base, **c}.values()) for i, c in enumerate(changes)], f"run_id int, {kinds}")
    good = [(j, f"j{j}", f"d{j}", 0.9, 0.95) for j in range(4)]
    scores = [(i, *s) for i in range(8) for s in good]
    scores += [(8, *s) for s in good[:3]] + [(9, j, f"j{j}", f"d{j}", float(j % 2), 0.95) for j in range(4)] + [(10, j, f"j{j}", f"d{j}", 0.1, 0.95) for j in range(4)] + [(8, 9, " j0 ", "d0", 0.0, 1.0)]
    out = {r.run_id: r for r in W.assessed(runs, spark.createDataFrame(scores, "run_id int, seq int, judge string, dimension string, score double, confidence double")).collect()}
    assert [(out[i].label, out[i].decision) for i in range(12)] == [
        ("PSEUDO_LABELED", "POSITIVE"), ("EVALUATION_ONLY", "EXCLUDED"), ("REJECTED", "EXCLUDED"), ("HUMAN_LABELED", "POSITIVE"), ("HUMAN_LABELED", "HOLDOUT"), ("REJECTED", "EXCLUDED"), ("REJECTED", "EXCLUDED"), ("REJECTED", "EXCLUDED"),
        ("UNLABELED", "HOLDOUT"), ("UNLABELED", "HOLDOUT"), ("UNLABELED", "HOLDOUT"), ("HUMAN_LABELED", "NEGATIVE"),
    ]
    assert (out[0].verifier, out[0].ai, out[0].total, out[0].agreement, out[0].confidence) == (0.9, 0.9, 0.9, 1.0, 0.95)
    assert out[2].reasons == "not_completed" and out[6].reasons == "no_reward" and out[8].n == 3 and out[3].confidence == 1.0


def test_process_reward_and_cost_bound(spark):
    rows = spark.createDataFrame([(True, "f", "r", [1, 1, 9], 0.5), (True, "f", " ", [9], 2.0), (True, None, "r", [], 0.0), (False, "f", "r", [1], 1.0)], "success boolean, findings string, recommendations string, sources array<int>, confidence double")
    assert [r.process for r in W.process_reward(rows.withColumn("max_source", F.lit(3)).coalesce(1)).collect()] == [0.9, 0.5, 0.4, 0.0]
    r = W.cost_bound(spark.createDataFrame([(10, 101), (0, 0)], "question_chars int, answer_chars int"), 1.0, 2.0).first()
    assert (r.n, r.calls, r.input_tokens, r.output_tokens, r.cost) == (2, 8, 4 * (889 + 750), 1600, (4 * 1639 + 2 * 1600) / 1e6)


def test_release_gates(spark):
    def gates(**change):
        rows = []
        for case in range(4):
            for variant, score, cost in (("baseline", 0.75, 9.0), ("single", 0.7, 1.0), ("multi", 0.7, 3.0), ("candidate", 0.8, 1.05)):
                row = {"case_id": case, "variant": variant, "score": score, "cost": cost, "measured": True, "failed": False, "mode": "SINGLE_AGENT", "expected_mode": "SINGLE_AGENT"}
                rows.append(tuple((row | change.get(variant, {}) | (change.get("first", {}) if variant == "candidate" and case == 0 else {})).values()))
        return E.release_gates(spark.createDataFrame(rows, "case_id int, variant string, score double, cost double, measured boolean, failed boolean, mode string, expected_mode string")).first()

    r = gates()
    assert (r.failed, r.cost_ratio, r.route_accuracy, r.critical_cases) == ("", 1.05, 1.0, 0)
    assert gates(candidate={"cost": 1.2}).failed == "cost" and gates(candidate={"cost": 1.2, "measured": False}).failed == ""
    assert gates(candidate={"cost": 3.0, "mode": "ADAPTIVE_MULTI_AGENT", "expected_mode": None}).failed == ""
    assert gates(first={"expected_mode": "ADAPTIVE_MULTI_AGENT"}).failed == "route" and gates(candidate={"score": 0.7}).failed == "score,regression"
    assert gates(first={"failed": True}).failed == "critical,failures" and gates(first={"score": 0.59}).failed == "critical"


def test_white_space_of_any_kind_is_stripped(spark):
    hidden, blank = "\n\t" + '{"queries": 1}' + "x" * 90, "\n\t　\r\n"
    out = scored(spark, {"answer": hidden}, {"answer": blank}, {"answer": "\n" * 50 + "y" * 70 + "\n" * 50})
    assert [r.violations for r in out] == [["internal_trace_exposed"], ["empty_answer", "answer_too_short"], ["answer_too_short"]]
    assert [r.total for r in out] == [0, 0, 0]


def test_blank_texts_fail_the_hard_checks(spark):
    rows = [("COMPLETED", None, q, a, 1.0, 1.0) for q, a in (("q", "a"), ("\n\t", "a"), ("q", "　 \r"), ("q", None), ("q", " "))]
    out = W.hard_checks(spark.createDataFrame(rows, "status string, error string, question string, answer string, grounding double, task double").coalesce(1)).collect()
    assert [r.reasons for r in out] == [[], ["blank_text"], ["blank_text"], ["blank_text"], []]
