import random

import pytest

from trailmill.llm import simhash as N
from trailmill.plans.shared_store import Store

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) >= 0.8 * len(x | y) if x or y else True


def classes(texts):
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(texts)):
        for j in range(i):
            if similar(texts[i], texts[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def made():
    """Base texts, each with copies whose similarity lies between 0.7 and 0.95."""
    rng = random.Random(11)
    out = []
    for k in range(12):
        words = [f"w{k}x{rng.randrange(4000)}" for _ in range(300)]
        out.append(" ".join(words))
        for changed in (2, 3, 5, 6, 8, 10):
            copy = list(words)
            for at in rng.sample(range(10, 290), changed):
                copy[at] = f"n{rng.randrange(10**9)}"
            out.append(" ".join(copy))
    return [*out, None, "", "one two", "One  TWO", "one two three"]


def test_stage_removes_near_copies_from_0_8(spark):
    texts = made()
    levels = [len(shingles(a) & shingles(texts[0])) / len(shingles(a) | shingles(texts[0])) for a in texts[1:7]]
    assert max(levels) > 0.9 and any(0.8 <= x < 0.9 for x in levels) and min(levels) < 0.8
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert left == set(classes(texts))


def test_components_match_brute_force(spark, docs, texts):
    out = {r.doc_id: r.component for r in N.similar(docs, Store(spark, "t"), "doc_id").collect()}
    want = classes(texts)
    assert all((out[i] == out[j]) == (want[i] == want[j]) for i in range(len(texts)) for j in range(i))


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Chains and clusters whose members share buckets without all being similar to any hub."""
    monkeypatch.setattr(N, "FEW", 3)
    rng = random.Random(8)
    texts = []
    for k in range(3):
        words = [f"c{k}x{i}" for i in range(150)]
        for step in range(25):
            if step % 5 == 4:
                words = list(words)
                words[rng.randrange(5, 145)] = f"s{k}x{step}"
            copy = list(words)
            for at in rng.sample(range(5, 145), rng.randrange(3)):
                copy[at] = f"n{rng.randrange(10**9)}"
            texts.append(" ".join(copy))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.component for r in N.similar(frame, Store(spark, "t"), "doc_id").collect()}
    want = classes(texts)
    assert len(set(want)) > 3
    assert all((out[i] == out[j]) == (want[i] == want[j]) for i in range(len(texts)) for j in range(i))


def test_large_group_stays_linear(spark, monkeypatch):
    """A group of k near copies is joined over about k pairs, not k squared."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*words, f"tail{rng.randrange(10**9)}"])) for i in range(300)]
    pairs = []
    store = Store(spark, "t")
    put = store.put
    monkeypatch.setattr(store, "put", lambda df: _noted(put(df), pairs))
    out = N.similar(spark.createDataFrame(rows, "doc_id long, text string"), store, "doc_id")
    assert out.select("component").distinct().count() == 1
    assert max(pairs) < 30 * 300


def _noted(frame, pairs):
    if frame.columns == ["a", "b"]:
        pairs.append(frame.count())
    return frame


def test_empty_table(spark, empty):
    assert N.similar(empty, Store(spark, "t"), "doc_id").count() == 0
