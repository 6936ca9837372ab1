import numpy as np
import xxhash

from trailmill.llm import simhash as S
from trailmill.plans.shared_store import Store


def slow(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps):
    """Least index reachable over at most 3 differing bits."""
    root = list(range(len(fps)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_whole_operator_matches_brute_force(spark, docs, texts):
    out = {r.doc_id: r for r in S.clustered(docs, Store(spark, "t")).collect()}
    fps = [slow(t) for t in texts]
    assert [out[i].fp & (1 << 64) - 1 for i in range(len(texts))] == fps
    assert [out[i].component for i in range(len(texts))] == classes(fps)


def clustered_numbers(rng, n):
    centres = rng.integers(0, 1 << 63, 6, dtype=np.int64).view(np.uint64)
    fps = []
    for _ in range(n):
        x = int(centres[rng.integers(len(centres))])
        for b in rng.integers(0, 64, rng.integers(0, 5)):
            x ^= 1 << int(b)
        fps.append(x)
    return sorted(set(fps))


def test_trie_walk_finds_every_pair():
    for seed in range(4):
        fps = clustered_numbers(np.random.default_rng(seed), 300)
        a = np.array(fps, np.uint64)
        found = {(int(x), int(y)) for p, q in S.trie_pairs(a, np.zeros(len(a), np.int64), 3) for x, y in zip(p, q)}
        want = {(i, j) for j in range(len(fps)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 3}
        assert found == want


def test_large_buckets_are_dealt_again_without_loss(spark):
    fps = clustered_numbers(np.random.default_rng(9), 250)
    frame = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fps)], "node long, fp long")
    store = Store(spark, "t")
    roots = {r.node: r.root for r in S.components(S.trie_links(frame, 3, store, bucket_rows=5), store).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == classes(fps)


def test_long_chains_settle(spark):
    store = Store(spark, "t")
    links = spark.range(200).selectExpr("id as a", "id + 1 as b")
    assert {r.root for r in S.components(links, store).collect()} == {0}


def test_empty_table(spark, empty):
    assert S.clustered(empty, Store(spark, "t")).count() == 0
