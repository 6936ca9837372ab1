import math
from collections import Counter

import numpy as np
import pytest

from trailmill.llm import language_model as M
from trailmill.plans.shared_store import Store


def test_base_scores_match_brute_force(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(M, "TOP_WORDS", 60)  # most words take the join
    out = {r.doc_id: r for r in M.scored(docs, Store(spark, "t")).collect()}
    tokens = [M._tokens((t or "").encode()) for t in texts]
    count = Counter(w for i, ws in enumerate(tokens) if not M.held_out(i) for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in enumerate(tokens):
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (M.held_out(i), len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)


def test_words_of_a_class_share_its_probability():
    count = Counter(b"the the a cat sat dog dig fig fin".split())
    top = count.most_common(4)
    totals = np.zeros(M.ENDINGS)
    for w, c in count.items():
        totals[M.ending(w)] += c + 1
    words = M.Words(top, np.log10(totals + 1))
    assert all(words.own[: min(4, M.OWN_CLASS)]) and not words.own[-1]
    ids, classes = words.classed([b"the", b"unknown"])
    assert ids.tolist() == [0, -1] and classes.tolist() == [0, M.OWN_CLASS + M.ending(b"unknown")]


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    x = rng.integers(0, M.CLASSES, (6, 3)).astype(np.int32)
    x[4:, 2] = -1
    fresh = np.zeros((6, 3), bool)
    fresh[0], fresh[3, 1] = True, True

    def loss(w):
        m = M.Gru(w)
        states, _, _ = m.forward(x, fresh, np.zeros((3, M.HIDDEN), np.float32), False)
        return -float(m.log_probs(states, x)[x >= 0].mean()) * math.log(10)

    model = M.Gru(seed=1)
    start = model.weights.copy()
    model.learn(x, fresh, np.zeros((3, M.HIDDEN), np.float32), 0.0)
    grad = model.m / 0.1
    for k in rng.choice(np.flatnonzero(np.abs(grad) > 0.02), 12):
        step = np.zeros_like(start)
        step[k] = 1e-2
        assert math.isclose((loss(start + step) - loss(start - step)) / 2e-2, grad[k], rel_tol=0.08, abs_tol=2e-3)


def test_state_runs_through_windows_and_lanes():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, M.CLASSES, n).astype(np.int32) for n in (1, 5, 40, 133, 16, 17)]
    model = M.Gru(seed=3)
    alone = [M.class_scores(model, [d])[0] for d in docs]
    assert np.allclose(M.class_scores(model, docs), alone, rtol=1e-4)


def test_held_out_texts_score_above_the_base(spark):
    """Sentences with word order: the model must beat the counts by a margin on texts it has not seen."""
    import random

    rng = random.Random(2)
    pair = {"the": "cat dog sun moon".split(), "cat": ["sat", "ran"], "dog": ["ran", "ate"], "sun": ["rose"], "moon": ["set"], "sat": ["on"], "ran": ["off"], "ate": ["it"], "rose": ["up"], "set": ["down"]}
    def text():
        out = []
        for _ in range(40):
            w = "the"
            while w:
                out.append(w)
                w = rng.choice(pair[w]) if w in pair else None
        return " ".join(out)

    frame = spark.createDataFrame([(i, text()) for i in range(300)], "doc_id long, text string").repartition(2)
    rows = [r for r in M.scored(frame, Store(spark, "t")).collect() if r.held_out]
    gain = sum(r.score - r.base_score for r in rows) / sum(r.n_tokens for r in rows)
    assert len(rows) > 20 and gain > 0.2


def test_learns_order():
    docs = [np.array([0, 1, 2, 3] * 50, np.int32) for _ in range(8)]
    model = M.Gru()
    before = M.class_scores(model, docs).sum()
    for _ in range(40):
        M.train(model, docs, 0.02)
    assert M.class_scores(model, docs).sum() > 0.2 * before


def test_empty_table(spark, empty):
    assert M.scored(empty, Store(spark, "t")).count() == 0


@pytest.mark.parametrize("frequent", [[], [b"a"], [M.END, b"a", b"bb"]])
def test_words_of_many_texts_at_once(frequent):
    words = M.Words([(w, 3) for w in frequent], np.zeros(M.ENDINGS))
    texts = [b"a b\tA c c", b"", b"c bb zz", b" \n", b"zz zz a"]
    found = list(words.texts(texts))
    for text, (ids, classes, rare), alone in zip(texts, found, words.class_lists(texts), strict=True):
        tokens = M._tokens(text)
        assert ids.tolist() == [frequent.index(t) if t in frequent else -1 for t in tokens]
        assert dict(rare) == {t: tokens.count(t) for t in tokens if t not in frequent}
        assert classes.tolist() == alone.tolist() and len(classes) == len(tokens)
    assert list(words.texts([])) == list(words.class_lists([])) == []
