from collections import defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_simhash import classes, slow  # noqa: E402
from trailmill.llm import secret_scan  # noqa: E402

CLEAN = " ".join(f"word{i * 7919 % 613}" for i in range(90))
ITEM = " ".join(f"item{i}x" for i in range(30))
TEXTS = [CLEAN, CLEAN, CLEAN + " tail", "short", None, "", CLEAN.replace("word", "other") + " " + ITEM, CLEAN.replace("word", "third") + " password=abc123def", "spam " * 200, " ".join(f"junk{i}###" for i in range(90))]


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(i, t, "en", "s", None if t is None else len(t), "x") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_take_effect_and_keep_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == names
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(seen["quality rules"]) == {0, 1, 2, 6, 7}
    ids = sorted(seen["quality rules"])
    root = classes([slow(TEXTS[i]) for i in ids])
    assert set(seen["near dedup"]) == {ids[k] for k in set(root)}
    assert set(seen["decontamination"]) == set(seen["near dedup"]) - {6}
    assert seen["secret scans"][7].endswith(" " + secret_scan.MARK)
    assert {r.n_chars == len(r.text) for r in docs.collect()} == {True}


def test_run_packs_what_is_left(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    by = defaultdict(int)
    for r in rows:
        by[r.doc_id] += r.length
    assert set(by) <= {0, 2, 7} and {0, 7} <= set(by)
    assert all(by[r.doc_id] == r.doc_tokens for r in rows)


def test_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


def test_native_stages_have_no_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k in (0, 2, 3):
        plan = corpus_pipeline.STAGES[k][1](spark, docs, folder)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


