"""Generation against a plain loop that stops at the target."""

import pytest
from pyspark.sql import functions as F

from trailmill.operators import seeds as S
from trailmill.plans.shared_store import Store

RADIX = {"a": 3, "b": 5, "c": 7}
TEXTS = ["alpha beta gamma delta {}", "the quick brown fox number {}", "a wholly different question {}"]


def plain(benchmark, target, threshold, suits, taken=()):
    norm = lambda t: "".join(ch for ch in t.lower() if ch.isalnum())
    grams = lambda t: {norm(t)[k : k + 3] for k in range(len(norm(t)) - 2)}
    seen, out, exact, near = set(taken), [], 0, 0
    for o in range(3 * 5 * 7):
        a, b, c = o // 35, o // 7 % 5, o % 7
        q = TEXTS[a].format("xyz"[b % 3] * 4 + str(c % 4))
        if norm(q) in seen:
            continue
        sims = [len(grams(q) & grams(t)) / len(grams(q) | grams(t)) for t in benchmark]
        inside = any(norm(q) in norm(t) or norm(t) in norm(q) for t in benchmark if min(len(norm(q)), len(norm(t))) >= 12)
        if max(sims) >= 1 or inside:
            exact += 1
        elif max(sims) >= threshold:
            near += 1
        elif suits(b):
            seen.add(norm(q))
            out.append((o, q))
            if len(out) == target:
                return out, exact, near, o + 1
    return out, exact, near, None


def build(df):
    text = F.element_at(F.array(*[F.lit(t) for t in TEXTS]), (F.col("a") + 1).cast("int"))
    word = F.concat(F.repeat(F.element_at(F.array(*map(F.lit, "xyz")), (F.col("b") % 3 + 1).cast("int")), F.lit(4)), (F.col("c") % 4).cast("string"))
    return df.withColumn("question", F.replace(text, F.lit("{}"), word))


BENCH = ["ALPHA beta gamma delta xxxx1!", "the quick brown fox number yyyy", "a wholly diferent question zzzz3", "short"]


@pytest.mark.parametrize(("target", "first_block"), [(1, 4), (10, 4), (14, 16), (16, 500)])
def test_as_a_loop(spark, target, first_block):
    bench = spark.createDataFrame(list(enumerate(BENCH)), "item_id long, text string")
    made = S.generated(spark, RADIX, build, bench, target, 0.7, Store(spark, "t"), suits=F.col("b") != 1, first_block=first_block)
    want, exact, near, tried = plain(BENCH, target, 0.7, lambda b: b != 1)
    assert sorted((r["ordinal"], r["question"]) for r in made.accepted.collect()) == want
    assert (made.exact, made.near, made.tried) == (exact, near, tried) and exact
    # Blocks double, and the last one holds the last candidate that was needed.
    assert first_block * (2 ** (made.blocks - 1) - 1) < tried <= first_block * (2**made.blocks - 1)


def test_what_others_took_is_taken(spark):
    bench = spark.createDataFrame(list(enumerate(BENCH)), "item_id long, text string")
    taken = spark.createDataFrame([("alphabetagammadeltaxxxx0",)], "form string")
    made = S.generated(spark, RADIX, build, bench, 5, 0.7, Store(spark, "t"), taken=taken)
    assert sorted(r["ordinal"] for r in made.accepted.collect()) == [o for o, _ in plain(BENCH, 5, 0.7, lambda b: True, ["alphabetagammadeltaxxxx0"])[0]]


def test_too_few_and_wrong_targets(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    with pytest.raises(ValueError, match="only 36 clean candidates of 105"):
        S.generated(spark, RADIX, build, bench, 1000, 0.7, Store(spark, "t"))
    for target, threshold in ((0, 0.5), (5, 1.0), (5, 0.0)):
        with pytest.raises(ValueError):
            S.generated(spark, RADIX, build, bench, target, threshold, Store(spark, "t"))


def test_shares_leave_one_of_each():
    assert [S.shares(*x) for x in ((10, 0.3), (10, 0.0), (10, 1.0), (10, 0.01), (1, 0.9), (2, 0.99))] == [(7, 3), (10, 0), (0, 10), (9, 1), (1, 0), (1, 1)]


@pytest.mark.parametrize(("n", "m"), [(5, 2), (2, 5), (3, 3), (0, 2), (4, 0)])
def test_lists_in_turn(spark, n, m):
    frame = lambda name, k: spark.createDataFrame([(name, 9000 * i) for i in range(k)], "name string, ordinal long")
    got = [(r["name"], r["ordinal"] // 9000) for r in S.interleaved(frame("a", n), frame("b", m)).orderBy("position").collect()]
    want = []
    for i in range(max(n, m)):
        want += [("a", i)] * (i < n) + [("b", i)] * (i < m)
    assert got == want


def test_nth(spark):
    numbers = [3 * x * x for x in range(300)]
    df = spark.createDataFrame([(x,) for x in numbers], "o long")
    assert [S.nth(df, "o", k) for k in (1, 150, 300, 301)] == [numbers[0], numbers[149], numbers[299], None]
