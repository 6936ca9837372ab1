"""Texts near any of a list, and cases that begin alike, against plain loops."""

import random

from trailmill.operators import datasets as D
from trailmill.operators import seeds as S


def grams(t):
    t = "".join(ch for ch in t.lower() if ch.isalnum())
    return {t[k : k + 3] for k in range(len(t) - 2)}


def test_near_any_as_a_loop(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**4)}" for _ in range(12)]
    made = lambda k: f"Supplier {rng.randrange(10**6):09d}; " + " ".join(words[k : k + 8])
    right = [(i, made(i % 4)) for i in range(40)]
    left = [(i, made(i % 5)) for i in range(60)] + [(100, right[7][1].upper()), (101, ""), (102, "short"), (103, None)]
    want = {}
    for i, t in left:
        sims = [len(grams(t) & grams(x)) / len(grams(t) | grams(x)) for _, x in right] if t else [0]
        if max(sims) >= 0.7:
            want[i] = max(sims) >= 1
    got = D.near_any(spark.createDataFrame(left, "left_id long, text string"), spark.createDataFrame(right, "right_id long, text string"), 0.7)
    assert {r.left_id: r.same for r in got.collect()} == want
    assert want[100] and 0 < len(want) < 60


def test_stretches_are_not_broadcast_and_cases_meet_few_documents(spark):
    """All texts begin alike: by their first characters, each of 200 cases met each of 200 documents."""
    rows = [(i, f"Supplier number {i:09d} and the rest") for i in range(200)]
    docs, cases = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, t[:30]) for i, t in rows], "item_id long, text string")
    out = D.contained(docs, cases)
    assert sorted((r.doc_id, r.item_id) for r in out.collect()) == [(i, j) for i, (_, t) in enumerate(rows) for j in range(200) if rows[j][1][:30] in t]
    kept = D.could_be_inside(cases.where("item_id < 3"), docs.where("doc_id > 1"))
    assert [r.item_id for r in kept.collect()] == [2]


def test_joins_of_verdicts_name_how_they_join(spark):
    """Small files hold many texts that are much alike; a broadcast of them does not fit the driver."""
    bench = spark.createDataFrame([(1, "alpha beta gamma delta one")], "item_id long, text string")
    questions = spark.createDataFrame([(1, "alpha beta gamma delta one"), (2, "something else of its own")], "ordinal long, question string")
    judged = S.against_benchmark(questions, bench, 0.8)
    assert {r.ordinal: r.verdict for r in judged.collect()} == {1: "exact", 2: None}
    assert judged._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") >= 6
