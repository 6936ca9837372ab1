import hashlib
from collections import Counter

from trailmill.llm import substring_dedup as S
from trailmill.plans.shared_store import Store

W = S.WINDOW


def slow(texts):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[k : k + W]) for w in words for k in range(len(w) - W + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for k in range(len(w) - W + 1):
            if seen[tuple(w[k : k + W])] > 1:
                gone[k : k + W] = [True] * W
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


def test_matches_brute_force_on_both_paths(spark, docs, texts):
    for shard_rows in (20_000, 1):  # 1: every phrase takes the path for large ones
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in S.deduplicated(docs, Store(spark, "t"), shard_rows=shard_rows).collect()}
        want = slow(texts)
        assert [got[i] for i in range(len(texts))] == want
        assert sum(x[1] for x in want) > 0


def test_periodic_text_and_overlaps(spark):
    texts = ["a b " * 100, "c " * 34, "c " * 36, " ".join(map(str, range(100))), " ".join(map(str, range(20, 90)))]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in S.deduplicated(frame, Store(spark, "t")).collect())
    assert got == [(i, x[1]) for i, x in enumerate(slow(texts))]


def test_empty_table(spark, empty):
    assert S.deduplicated(empty, Store(spark, "t")).count() == 0
