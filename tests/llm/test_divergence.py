import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from trailmill.llm import divergence
from trailmill.plans.shared_store import Store


def plain(rows, min_docs, top=10):
    """(text, lang, source) -> expected rows, in Python integers."""
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang or "", source or ""))
        count[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = set()
    for lang in {g for g, _ in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update({t: count[g][t] for t in kept})

        def p(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        f = lambda a, b: (a - b) ** 2 // (a + b)
        q, mine = p(whole), {g: p(count[g]) for g in groups if g[0] == lang}
        for g in mine:
            pairs = [(-sum(f(mine[g][t], mine[o][t]) for t in kept), o[1]) for o in mine if o != g]
            terms = [(-f(mine[g][t], q[t]), t) for t in kept if count[g][t] and mine[g][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (x[0], x[1].encode()))
                out |= {(*g, part, item, -v, n) for n, (v, item) in enumerate(ranked, 1) if part == "pair" or n <= top}
    return out


def as_set(df):
    return {tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()}


@pytest.mark.parametrize("cell", [divergence.CELL, 8])
def test_every_pair_and_term(spark, docs, texts, cell):
    """Null texts, languages and sources, repeated rows, a very long text, clashing columns; many rounds and shards with small cells."""
    from pyspark.sql import functions as F

    spread = docs.withColumns({"source": F.when(F.col("doc_id") % 7 > 0, F.concat(F.lit("s"), F.col("doc_id") % 7)), "term": F.lit(1), "block": F.lit(2)})
    rows = [(r["text"], r["lang"], r["source"]) for r in spread.collect()]
    got = divergence.audited(spread, Store(spark, "t"), min_docs=2, cell=cell)
    assert as_set(got) == plain(rows, 2)
    assert got.count() == len(plain(rows, 2))


def test_nothing_kept_and_one_source(spark):
    rows = [("a b", "x", "one"), ("c", "x", "two"), (None, "y", None), ("9 -", "z", "k")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert as_set(divergence.audited(df, Store(spark, "t"))) == {("x", "one", "pair", "two", 0, 1), ("x", "two", "pair", "one", 0, 1)}


def test_empty_table(spark, empty):
    assert divergence.audited(empty, Store(spark, "t")).count() == 0


@given(st.integers(0, 9 * 10**15 // 4), st.integers(0, 9 * 10**15 // 4), st.integers(1, 10**9))
def test_long_division(count, more, kept):
    total = count + more
    assert divergence.probability(np.array([count]), total, kept)[0] == 1 + 10**9 * (count + 2) // (total + 2 * kept)


def test_matches_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = duckdb.sql(f"SELECT lang, source, part, item, value, rank FROM ({divergence.ORACLE_SQL})").fetchall()
    assert as_set(divergence.query(spark, folder)) == set(want)
