import re
from collections import Counter

from pyspark.sql import functions as F

from trailmill.llm import quality as Q
from trailmill.plans.shared_store import Store


def slow(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    again = Counter(windows)
    covered = {k + j for k, x in enumerate(windows) if again[x] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


JUNK = ["a b c d\n" * 30, "p q r " * 40 + "z", "word*** other### " * 40, " ".join(f"w{i % 61} v{i} u{i % 7}" for i in range(300))]


def test_counts_match_brute_force(spark, texts):
    every = texts + JUNK
    frame = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(every)], "doc_id long, text string, lang string, source string")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = {r.doc_id: r for r in Q.judged_counts(frame, Q.Rules(), Store(spark, "t")).collect()}
    for i, t in enumerate(every):
        want = slow(t)
        assert tuple(out[i][n] for n in names) == want, i
        assert out[i].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (out[i].base_failed and out[i].kept)


def judged(frame):
    return Q.judged(frame, "_q").select("*", "_q.kept")


def test_clean_stays_and_junk_goes(spark):
    clean = [" ".join(f"w{(i * 31 + k * k) % 997}" for k in range(80 + i)) for i in range(60)]
    junk = [" ".join(f"w{k * (i + 2)}###" for k in range(80)) for i in range(10)]
    frame = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(clean + junk)], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in judged(frame).where("kept").collect()}
    assert kept == set(range(60))


def test_the_fence_of_a_group_decides(spark):
    """The same text passes where symbols are usual and goes where they are not."""
    prose = [" ".join(f"w{(i * 31 + k * k) % 997}" for k in range(80 + i)) for i in range(60)]
    code = [" ".join(f"w{(i * 31 + k * k) % 997}" + "#" * (k % (2 + i % 9) == 0) for k in range(80 + i)) for i in range(60)]
    probe = " ".join(f"w{(5 + k * k * 7) % 997}" + "#" * (k % 4 == 0) for k in range(90))
    rows = [(t, "prose") for t in [*prose, probe]] + [(t, "code") for t in [*code, probe]] + [(probe, "few")]
    frame = spark.createDataFrame([(i, t, "en", s) for i, (t, s) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    out = {(r.source, r.text == probe): r.n for r in judged(frame).where("kept").groupBy("source", "text").count().withColumnRenamed("count", "n").collect()}
    assert ("code", True) in out and ("prose", True) not in out and ("prose", False) in out and ("code", False) in out
    # A small group takes the fence of its language, here that of both kinds together.
    assert ("few", True) in out


def test_null_groups_clashing_names_and_empty_table(spark, docs, empty):
    out = Q.judged(docs, "verdict")
    assert out.columns == [*docs.columns, "verdict"] and {r.kept for r in out.collect()} == {"mine"} and out.count() == docs.count()
    assert Q.judged(empty).count() == 0
    shuffled = Q.judged(docs, "verdict", Q.Rules(broadcast_groups=0)).groupBy("verdict.kept").agg(F.count("*").alias("n"))
    assert sorted(shuffled.collect()) == sorted(out.groupBy("verdict.kept").agg(F.count("*").alias("n")).collect())
