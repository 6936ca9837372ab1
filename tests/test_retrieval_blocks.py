"""Vector and lexical search in blocks, against plain loops; memory of a block."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from trailmill.operators import retrieval as R
from trailmill.sources import vector_index as V


def hits(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.item_id, r.score))
    return out


@pytest.mark.parametrize(("query_rows", "item_rows"), [(8192, 32_768), (3, 50)])
def test_vectors_in_blocks(spark, query_rows, item_rows):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(200)]
    rows += [(200 + i, rows[7][1]) for i in range(40)]  # copies: ties go by id
    queries = rows[:20]
    odd = [(900, None), (901, [1.0, None, 1.0, 1.0]), (902, [9.0, 9.0]), (903, [])]
    corpus = spark.createDataFrame(rows + odd, "item_id long, v array<float>")
    got = hits(R.vector_topk(spark.createDataFrame([*queries, (77, None)], "query_id long, q array<float>"), corpus, 5, 0.2, query_rows, item_rows))
    for q, v in queries:
        scored = [(i, np.floor(np.dot(np.float64(v), np.float64(x)) * 1e6 + 0.5) / 1e6) for i, x in rows]
        assert got.get(q, []) == sorted([h for h in scored if h[1] >= 0.2], key=lambda h: (-h[1], h[0]))[:5]
    assert set(got) <= {q for q, _ in queries}


def test_memory_of_a_block_of_vectors():
    """A whole block's scores would take 512 MB."""
    rng = np.random.default_rng(2)
    table = lambda name, n, v: pa.table({name: pa.array(range(n), pa.int64()), v: pa.FixedSizeListArray.from_arrays(pa.array(rng.normal(size=n * 4)), 4).cast(pa.list_(pa.float64()))})
    tracemalloc.start()
    out = V.best_products(3, 0.1)(table("item_id", 16_384, "v"), table("query_id", 4096, "q"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 3 * 4096 and peak < 250e6


@pytest.mark.parametrize("block", [4096, 7])
def test_lexical_in_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(R, "_BLOCK_SCORES", 300)
    rng = random.Random(6)
    words = ["the", *(f"w{n}" for n in range(30)), "\u8d28", "\u91cf"]
    text = lambda n: " ".join(["the", *rng.choices(words, k=n)])
    docs = [(i, text(rng.randrange(12))) for i in range(500)] + [(500, None), (501, ""), (502, "!")]
    asked = [(1000 + i, text(6)) for i in range(20)] + [(1100, None), (1101, "...")]
    rng.shuffle(docs)
    terms = lambda t: {w for w in (t or "").split() if len(w) > 1 or w > "\u3000"}
    weight = lambda ts: sum(0.25 if len(t) == 1 else 1.0 for t in ts)
    got = hits(R.lexical_topk(spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(docs, "item_id long, text string"), 10, block))
    for q, t in asked[:20]:
        scored = [(i, int(weight(terms(t) & terms(d)) / weight(terms(t)) * 1e6 + 0.5) / 1e6) for i, d in docs]
        assert got[q] == sorted([h for h in scored if h[1] > 0], key=lambda h: (-h[1], h[0]))[:10]
    assert len(got) == 20
