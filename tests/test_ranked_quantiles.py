"""Ranked quantiles by brute force, and without a rank over a whole group."""

import math

from trailmill.operators import summaries as U


def test_by_brute_force(spark):
    values = {"a": [((k * 53) % 97 - 30) / 8 for k in range(200)], "b": [2.5] * 7 + [-1.0], None: [1.0, float("nan"), float("nan")], "c": [4.0]}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("a", None)]
    for p in (0.0, 0.3, 0.5, 0.975, 1.0):
        out = U.ranked_quantiles(spark.createDataFrame(rows, "g string, v double"), "v", p, "g")
        assert "row_number" not in out._jdf.queryExecution().optimizedPlan().toString()
        got = {r["g"]: (r["n"], repr(r["by_floor"]), repr(r["by_round"])) for r in out.collect()}
        order = lambda v: (math.isnan(v), v)
        want = {g: (len(vs), *(repr(sorted(vs, key=order)[int(at((len(vs) - 1) * p))]) for at in (math.floor, round))) for g, vs in values.items()}
        assert got == want
