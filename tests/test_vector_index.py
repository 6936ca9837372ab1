"""The kept index: exactness, pruning, reuse, rebuilding, half-written indexes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmill.plans.shared_store import shared_root
from trailmill.sources import vector_index as V

SCHEMA = "item_id long, v array<float>, label string"


def clouds(n, width=8, groups=12, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, width))
    return [(k, (centre[k % groups] + 0.05 * rng.normal(size=width)).astype(np.float32).tolist(), "ab"[k % 2]) for k in range(n)]


def plain(rows, queries, k, threshold, label=None):
    out = {}
    for q, v in queries:
        hits = [(np.floor(np.dot(np.float64(x), np.float64(v)) * 1e6 + 0.5) / 1e6, i) for i, x, name in rows if label in (None, name)]
        out[q] = [i for s, i in sorted(hits, key=lambda h: (-h[0], h[1])) if s >= threshold][:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["item_id"])
    return out


@pytest.fixture
def folder(spark):
    return f"{shared_root(spark)}/index-{random.random()}"


@pytest.mark.parametrize(("label", "k", "threshold"), [(None, 5, -9.0), (None, 60, 0.5), ("b", 7, 0.0)])
def test_exact_and_filtered(spark, folder, label, k, threshold):
    rows = clouds(400) + [(900 + j, [0.0] * 8, "a") for j in range(3)]
    index = V.opened(spark, folder, "one", lambda: spark.createDataFrame(rows, SCHEMA), SCHEMA, part_rows=4)
    queries = [(i, v) for i, v, _ in rows[:20]] + [(77, [-x for x in rows[3][1]])]
    got = found(V.search(index, spark.createDataFrame(queries, "query_id long, q array<double>"), k, threshold, None if label is None else F.col("label") == label))
    want = plain(rows, queries, k, max(threshold, 0.0) if threshold < 0 else threshold, label)
    for q, _ in queries:
        assert got.get(q, [])[: len(want[q])] == want[q]


def test_reads_only_near_folders(spark, folder):
    rows = clouds(1200)
    index = V.opened(spark, folder, "one", lambda: spark.createDataFrame(rows, SCHEMA), SCHEMA)
    asked = spark.createDataFrame([(0, rows[0][1])], "query_id long, q array<double>")
    pivots = index.pivots().collect()
    first, rest = V._bounds(pivots)
    opened = asked.mapInArrow(first(5), "query_id long, q array<double>, pivot int").count()
    best = V.search(index, asked, 5).agg(F.min("score")).first()[0]
    more = asked.withColumn("floor", F.lit(float(best))).mapInArrow(rest(5), "query_id long, q array<double>, pivot int").count()
    assert opened + more < len(pivots) / 2


def test_second_run_reads_the_index_alone(spark, folder):
    rows, asked = clouds(60), []

    def vectors():
        asked.append(1)
        return spark.createDataFrame(rows, SCHEMA)

    assert V.opened(spark, folder, "one", vectors, SCHEMA).built
    assert not V.opened(spark, folder, "one", vectors, SCHEMA).built and len(asked) == 1
    assert V.opened(spark, folder, "two", vectors, SCHEMA).built and len(asked) == 2
    # The older one is gone, and one that was cut short is built again.
    assert V.opened(spark, folder, "one", vectors, SCHEMA).built
    index = V.opened(spark, folder, "one", vectors, SCHEMA)
    assert not index.built
    V.removed(spark, f"{index.folder}/pivots/_SUCCESS")
    assert V.opened(spark, folder, "one", vectors, SCHEMA).built


def test_fingerprints(spark, folder):
    rows = [(k, f"text {k % 50}") for k in range(300)]
    frame = lambda r, n: spark.createDataFrame(r, "id long, text string").repartition(n)
    one = V.digest(frame(rows, 3).select("text"))
    assert one == V.digest(frame(rows[::-1], 7).select("text"))
    assert one != V.digest(frame(rows[1:], 3).select("text")) != V.digest(frame([*rows[2:], (0, "text 0"), (1, None)], 3).select("text"))
    assert len(V.digest(frame([], 1).select("text"))) == 64
    frame(rows, 2).write.parquet(f"{folder}/t")
    before = V.file_fingerprint(spark.read.parquet(f"{folder}/t"))
    assert before == V.file_fingerprint(spark.read.parquet(f"{folder}/t"))
    frame(rows[:1], 1).write.mode("append").parquet(f"{folder}/t")
    assert before != V.file_fingerprint(spark.read.parquet(f"{folder}/t"))


def test_empty_table(spark, folder):
    index = V.opened(spark, folder, "none", lambda: spark.createDataFrame([], SCHEMA), SCHEMA)
    assert V.search(index, spark.createDataFrame([(1, [0.0])], "query_id long, q array<double>"), 3).count() == 0
