"""Literal cases and invariants of the kernels."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from trailmill.functions import text as T
from trailmill.functions.numeric import java_hash, jround
from trailmill.operators import datasets as D
from trailmill.operators import evaluation as E
from trailmill.operators import policy as P
from trailmill.operators import retrieval as R
from trailmill.operators import rewards as W
from trailmill.operators import state as S


def value(spark, column, **given):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()]).select(column.alias("v")).first().v


def test_rounding_and_hash(spark):
    assert value(spark, jround(F.lit(0.00145), 4)) == 0.0014
    assert value(spark, java_hash(F.lit("hello"))) == 99162322
    assert value(spark, java_hash(F.lit(""))) == 0


def test_dynamic_k(spark):
    for text, k in (("家务分工", 3), ("如何改善夫妻之间长期存在的沟通冲突", 4), ("如何改善沟通，同时分别处理家务分工以及双方父母之间的长期矛盾和经济压力问题", 6)):
        assert value(spark, R.dynamic_k(F.lit(text))) == k


def test_han_bigrams_and_coverage(spark):
    assert value(spark, T.retrieval_terms(F.lit("家务分工 AB c 我"))) == ["ab", "家务", "务分", "分工", "我"]
    assert value(spark, T.weighted_coverage(F.array(F.lit("家务"), F.lit("我")), F.lit("谈家务"))) == pytest.approx(0.8)


def test_ngrams_and_jaccard(spark):
    grams = lambda s: T.char_ngrams(F.lit(s))
    assert value(spark, grams("abcabc")) == ["abc", "bca", "cab"] and value(spark, grams("ab")) == ["ab"] and value(spark, grams("")) == []
    assert value(spark, T.jaccard(grams("abcd"), grams("abcd"))) == 1.0 and value(spark, T.jaccard(grams(""), grams(""))) == 0.0


def test_citations(spark):
    assert value(spark, T.citations(F.lit("a [来源 2] b [来源1] [来源 2]"))) == [2, 1]
    known = F.array(F.lit(1), F.lit(2))
    assert value(spark, T.citations_valid(F.lit("x [来源 2]"), known)) and not value(spark, T.citations_valid(F.lit("x [来源 3]"), known)) and not value(spark, T.citations_valid(F.lit("x"), known))
    assert value(spark, T.citations_valid(F.lit("x"), F.array().cast("array<int>")))


def test_fusion_keeps_one_row_per_item(spark):
    v = spark.createDataFrame([(1, "generic", 0.95, 1), (1, "both", 0.5, 2)], "query_id int, item_id string, score double, rank long")
    x = spark.createDataFrame([(1, "exact", 1.0, 1), (1, "both", 0.9, 2)], "query_id int, item_id string, score double, rank long")
    queries = spark.createDataFrame([(1, "a question")], "query_id int, text string")
    corpus = spark.createDataFrame([("generic", ""), ("both", ""), ("exact", "")], "item_id string, text string")
    out = R.reranked(v, x, queries, corpus, 5).collect()
    assert sorted(r.item_id for r in out) == ["both", "exact", "generic"] and out[0].rank == 1


def logged(spark, rows):
    return spark.createDataFrame(rows, "mode string, reward double, target string, probability double, exploration boolean")


def test_snips(spark):
    rows = [(P.SINGLE, 0.6, P.MULTI, 0.5, True)] * 2 + [(P.MULTI, 0.9, P.MULTI, 0.5, True)] * 2
    r = P.snips(logged(spark, rows), min_per_action=2, min_ess=2).first()
    assert (r.behavior_reward, r.policy_reward, r.lift, r.effective_samples, r.state) == (0.75, 0.9, 0.15, 2.0, "READY")
    worse = [(P.SINGLE, 0.9, P.MULTI, 0.5, True)] * 2 + [(P.MULTI, 0.5, P.MULTI, 0.5, True)] * 2
    assert P.snips(logged(spark, worse), min_per_action=2, min_ess=2).first().state == "REGRESSION"
    none = P.snips(logged(spark, [(P.SINGLE, 0.9, P.MULTI, None, True)])).first()
    assert (none.state, none.logged) == ("COLLECTING", 0)


def test_streaks(spark):
    states = ["DRIFTED", "DRIFTED", "HEALTHY", "DRIFTED", "DRIFTED", "DRIFTED"]
    out = P.streaks(spark.createDataFrame([("m", i, s) for i, s in enumerate(states)], "monitor string, at int, state string")).orderBy("at").collect()
    assert [r.streak for r in out] == [1, 2, 0, 1, 2, 3] and [r.rolled_back for r in out] == [False] * 5 + [True]


def test_divergence(spark):
    frame = lambda rows: spark.createDataFrame(rows, "f boolean, c string")
    assert P.divergence(frame([(True, "a"), (False, "b")]), "f", "c").first().js == 1.0
    assert P.divergence(frame([(True, "a"), (False, "a")]), "f", "c").first().js == 0.0
    assert P.divergence(frame([(True, "a")]), "f", "c").first().js == 0.0


def test_bootstrap_of_a_constant(spark):
    pairs = spark.createDataFrame([(i, 0.05) for i in range(36)], "case_id int, delta double")
    b, s = E.bootstrap(pairs, 50, "k").first(), E.paired_stats(pairs).first()
    assert (b.low, b.high, b.above) == (0.05, 0.05, 1.0) and (s.wins, s.ties, s.losses) == (36, 0, 0) and s.sign_p < 1e-6
    assert E.bootstrap(pairs.limit(0), 50, "k").count() == 0


def test_online_reward(spark):
    row = [(2, "GROUNDED", False, 1.0, 4, 0, None, 0, 0, 0.0)]
    out = W.online_reward(spark.createDataFrame(row, "n_documents int, grounding string, sufficient boolean, task double, model_calls int, follow_ups int, rating int, specialists int, specialist_ok int, process double")).first()
    assert (out.total, out.evidence, out.task_quality) == (0.8375, 0.25, 1.0)


def test_splits_are_disjoint_and_sized(spark):
    rows = spark.range(1003).withColumnRenamed("id", "k")
    assert D.hash_split(rows, "k", 0.1).where("validation").count() == 100
    assert D.hash_split(rows.limit(2), "k", 0.01).where("validation").count() == 1
    start = dt.datetime(2024, 1, 1)
    runs = spark.createDataFrame([(i, start + dt.timedelta(hours=5 * i)) for i in range(40)], "run_id long, completed_at timestamp")
    late = {r.run_id for r in P.temporal_split(runs).where("validation").collect()}
    assert late == set(range(30, 40))


def test_prefix_filter_loses_no_match(spark):
    texts = ["the quick brown fox jumps over", "the quick brown fox jumps ove", "completely different words here", "the quick brown fox jumped over", "", "ab"]
    frame = spark.createDataFrame(list(enumerate(texts)), "left_id int, text string")
    got = {(r.left_id, r.right_id) for r in D.near_matches(frame, frame.withColumnRenamed("left_id", "right_id"), 0.7).collect()}
    norm = ["".join(c for c in t if c.isalnum()) for t in texts]
    grams = [{n[k : k + 3] for k in range(len(n) - 2)} or ({n} if n else set()) for n in norm]
    want = {(i, j) for i, a in enumerate(grams) for j, b in enumerate(grams) if a | b and len(a & b) / len(a | b) >= 0.7}
    assert got == want


def test_state_fold_absorbs(spark):
    rows = [(1, 1, 1, "queued"), (1, 2, 2, "started"), (1, 3, 3, "completed"), (1, 4, 4, "started"), (2, 1, 5, "queued"), (2, 2, 6, "noise")]
    out = {r.run_id: r.status for r in S.folded(spark.createDataFrame(rows, "run_id int, at int, event_id int, type string")).collect()}
    assert out == {1: "COMPLETED", 2: "QUEUED"}


def test_stream_equals_batch_over_many_files(spark, tmp_path):
    from trailmill.plans.shared_store import Store
    from trailmill.streaming import runs

    kinds = ["queued", "started", "completed", "failed"]
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=(i * 37) % 500), i % 7, kinds[i * 5 % 4], 1.0, "{}") for i in range(200)]
    whole = spark.createDataFrame(rows, runs.EVENTS)
    for k in range(5):
        whole.where(F.col("event_id") % 5 == k).coalesce(1).write.parquet(str(tmp_path / f"events{k}.parquet"))
    shape = lambda d: d.select(F.col("user_id").alias("run_id"), F.col("ts").alias("at"), "event_id", F.col("event_type").alias("type"))
    stream = spark.readStream.schema(runs.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events*.parquet"))
    got = runs.drained(runs.folded(shape(stream)), Store(spark, "t"), ["run_id"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, S.folded(shape(whole)).collect()))


def test_run_files(spark, tmp_path):
    from trailmill.sources import files

    run = {"trajectoryId": "a-1", "status": "COMPLETED", "completedAt": "2024-01-01T00:00:00Z", "steps": [{"type": "ROUTE", "durationMs": 5, "output": {"mode": P.MULTI, "featureBucket": "b"}}, {"type": "PLAN", "durationMs": 7}], "reward": {"total": 0.9}}
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs/a.json").write_text(json.dumps(run))
    r = files.observations(files.read_runs(spark, str(tmp_path / "runs"))).first()
    assert (r.run_id, r.mode, r.bucket, r.latency_ms, r.cost, r.selected) == ("a-1", P.MULTI, "b", 12, None, False)
    (tmp_path / "runs/bad.json").write_text("{oops")
    good, bad = files.read_quarantined(spark, str(tmp_path / "runs"), "trajectoryId string, status string")
    assert good.count() == 1 and bad.count() == 1


def test_text_files(spark, tmp_path):
    from trailmill.sources import files

    (tmp_path / "x.jsonl").write_text('# note\n\n{"id": "1", "n": 2}\n{"id": broken\n')
    rows, bad = files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "id string, n int")
    assert [tuple(r) for r in rows.collect()] == [("1", 2)] and bad.count() == 1
    (tmp_path / "md").mkdir()
    (tmp_path / "md/guide-ok.md").write_text("one\n> quote\n---\n#### Title\nBody\n```\ncode\n```\nmore\n#### Next\nEnd\n")
    parts = files.read_markdown(spark, str(tmp_path / "md")).orderBy("part").collect()
    assert len(parts) == 2 and parts[0].text == "one" and "code" not in parts[1].text
    assert [(r.title, r.answer.split("\n")[0]) for r in files.read_sections(spark, str(tmp_path / "md")).orderBy("section").collect()] == [("Title", "Body"), ("Next", "End")]
    report = spark.createDataFrame([(1,)], "a int")
    assert files.write_once(spark, report, str(tmp_path / "r"), "f" * 64) and not files.write_once(spark, report, str(tmp_path / "r"), "f" * 64)
    new = files.upsert(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, v int, x string"), spark.createDataFrame([(1, 2, "c")], "k int, v int, x string"), "k", "v")
    assert sorted(map(tuple, new.collect())) == [(1, 2, "c"), (2, 1, "b")]
