from trailmill.llm import decontam as D
from trailmill.plans.shared_store import Store

ITEM = "a train leaves the station at 12:30 with Alice and 40 boxes and 12 kg of apples while 40 people wait outside for rain"
DOCS = [
    None, "", "short " + ITEM[:30], "Intro text. " + ITEM + " And more.", ITEM.upper().replace("ALICE", "Alice"), "x " * 500 + ITEM,
    ITEM.replace("40", "77").replace("12 kg", "19 kg").replace("12:30", "11:15").replace("Alice", "Berta"), ITEM.replace("40 people", "41 people").replace("40 boxes", "39 boxes"),
    "a train leaves the garden while nobody waits", " ".join(f"{i} {i + 1}" for i in range(60)), ITEM, ITEM,
]


def found(spark, docs, items):
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in D.leaks(frame, bench, Store(spark, "t")).collect()}


def test_copies_and_changed_parameters_are_caught(spark):
    out = found(spark, DOCS, [ITEM, None, "", "too short to tell", "..."])
    assert {k[0] for k in out} >= {3, 4, 5, 6, 10, 11} and not {k[0] for k in out} & {0, 1, 2, 8, 9}
    assert {k[1] for k in out} == {0}
    assert out[6, 0].reparameterised and not out[3, 0].reparameterised


def test_inconsistent_slots_are_no_evidence(spark):
    item = "take 5 apples and add 5 pears then sum the two numbers to get the final answer here"
    same, other = item.replace("5", "8"), item.replace("5 apples", "8 apples").replace("5 pears", "9 pears")
    out = found(spark, [same, other], [item])
    # Two of the six windows hold both numbers.
    assert (out[0, 0].n_windows, out[1, 0].n_windows) == (6, 4)
    near = "add 5 apples to 5 pears and 5 plums in all the big bowls"
    assert set(found(spark, [near.replace("5", "7"), near.replace("5 pears", "6 pears")], [near])) == {(0, 0)}


def test_short_items_are_found_whole(spark):
    items = ["what is the largest city of that old country", "add 3 apples to 3 pears and then count", "one two three four five six seven eight nine ten eleven twelve", "too few words here", "who wrote it first"]
    docs = ["Intro. " + items[0] + "? Answer.", items[0].rsplit(" ", 1)[0], items[1].replace("3", "9"), items[1].replace("3 pears", "4 pears"), "x " * 300 + items[2], "So: too few words here.", None, items[2][:-7], "too few words", "He asked who wrote it first?"]
    assert set(found(spark, docs, items)) == {(0, 0), (2, 1), (4, 2), (5, 3), (9, 4)}


def test_copies_are_found_whatever_they_are_made_of(spark):
    items = ["What is 12 plus 30 minus 7", "Compute 12 + 30 * 4 - 7 / 2", "Name the capital of Peru", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15", "42", "zebra", "--", "2 kg"]
    docs = ["Quiz. " + items[0] + "? Go.", "Now: compute 12 + 30 * 4 - 7 / 2!", "Please name the capital of Peru now", "0 " + items[3] + " 16", "it is 42 here", "one zebra", "2 kg of it", "nothing"]
    assert set(found(spark, docs, items)) == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 7)}
    # After a colon the first word looks like a name.
    inside = ["Question: What is 12 plus 30 minus 7", "Task: Compute 12 + 30 * 4 - 7 / 2", "please Name the capital of Peru", "so, Thus the very first word of all thirteen stays in its own place"]
    assert set(found(spark, inside, [*items, "Thus the very first word of all thirteen stays in its own place"])) == {(0, 0), (1, 1), (2, 2), (3, 8)}
    assert not found(spark, ["Question: Who is 12 plus 30 minus 7"], items)
    # With other values such items are no evidence: too little of them is left.
    other = ["What is 13 plus 30 minus 7", "compute 1 + 3 * 5 - 8 / 9", "Please name the capital of Chile now", "21 22 23 24 25 26 27 28 29 30 31 32 33 34 35", "it is 43 here", "3 kg of it"]
    assert not found(spark, other, items)
    long = "add 3 apples to 3 pears and then count 4 of all"
    assert found(spark, [long.replace("3", "9")], [long])[0, 0].reparameterised


def test_very_long_texts_ties_and_repeats(spark):
    item = " ".join(f"q{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
    docs = ["w " * 200_000 + item + " v" * 100_000, item + " and " + item, item]
    out = found(spark, docs, [item, item])
    assert set(out) == {(d, i) for d in range(3) for i in range(2)} and {r.n_windows for r in out.values()} == {40 - D.WIDTH + 1}


def test_any_column_names(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(1, ITEM), (None, ITEM)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("h", "w", "at", "_id", "template", "item_id")})
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string").withColumns({c: F.lit(2) for c in ("n", "t", "doc_id")})
    assert {r.doc_id for r in D.leaks(frame, bench, Store(spark, "t")).collect()} == {1, None}


def test_every_place_of_a_passage_is_seen(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    docs = [" ".join(["pad"] * k + words[20 : 20 + D.WIDTH] + ["end"]) for k in range(14)]
    assert {d for d, _ in found(spark, docs, [" ".join(words)])} == set(range(14))


def test_clean_keeps_rows_and_columns(spark, docs, empty):
    frame = docs.withColumnRenamed("kept", "_id")
    bench = spark.createDataFrame([(0, ITEM)], "item_id long, text string")
    out = D.clean(frame, bench, Store(spark, "t"))
    assert out.columns == frame.columns and out.count() == frame.count()
    assert D.clean(empty, bench, Store(spark, "t")).count() == 0
    assert D.leaks(frame, bench.limit(0), Store(spark, "t")).count() == 0
