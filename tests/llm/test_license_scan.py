from trailmill.llm import license_scan as L

TEXTS = [None, "", "Released under the MIT License.", "x " * 3000 + "Licensed under the Apache License, Version 2.0. " + "y " * 50, "This text mentions a license but grants nothing at all to anyone", "RELEASED UNDER THE MIT LICENSE", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."]


def rows(spark, texts):
    return sorted((r.doc_id, r.license, r.n_windows) for r in L.matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect() if r.containment == 10000)


def test_notices_are_found_anywhere(spark):
    assert rows(spark, TEXTS) == [(2, "MIT", 1), (3, "Apache-2.0", 1), (5, "MIT", 1), (6, "MIT", 1), (7, "CC-BY-NC-4.0", 1), (7, "MIT", 1)]


def test_every_template_is_found(spark):
    every = [t for ts in L.TEMPLATES.values() for t in ts] + [f"SPDX-License-Identifier: {n}" for n in L.TAGGED]
    names = [n for n, ts in L.TEMPLATES.items() for _ in ts] + list(L.TAGGED)
    out = rows(spark, ["pad " * k + t + " pad" * 9 for k, t in enumerate(every)])
    assert {(d, n) for d, n, _ in out} >= set(enumerate(names))


def test_hitting_set_leaves_no_window_out():
    words = set(L.hitting_words())
    for _, _, _, ss in L.notices():
        unmet = [s for s in ss if not words & set(s.split())]
        assert len(unmet) < L.CONTAINMENT * len(ss)


def test_retrieval_probability():
    worst = min((len(s) * L.CONTAINMENT) / (len(s) + L.stride(n) - 1 + (1 - L.CONTAINMENT) * len(s)) for _, _, n, s in L.notices())
    assert 1 - (1 - worst) ** L.BANDS > 0.9999


def test_empty_table_and_other_columns(spark, docs, empty):
    assert L.matches(empty).count() == 0 and L.matches(docs).count() == 0
