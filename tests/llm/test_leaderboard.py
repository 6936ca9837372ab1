import random
import zlib
from datetime import date, datetime, timedelta
from math import floor

import duckdb
import numpy as np
import pandas as pd
import pytest

from trailmill.llm import leaderboard
from trailmill.plans.shared_store import Store

LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz, shard string"
VENDORS, ITEMS = "vendor_id long, name string, nation_id int, balance double", "item_id long, name string, price double"


def plain(lines, nation, price):
    """A board after each day, kept with plain dictionaries."""
    placed, newest = [], {}
    for sale, line, item, vendor, quantity, amount, _, flag, at, _ in lines:
        h = zlib.crc32(",".join("" if x is None else str(x) for x in (sale, item, vendor, line)).encode())
        s = (at.date() - date(1970, 1, 1)).days if at else 19723 + h % 150
        a = s + h % 7 + (20 if h % 5 == 0 else 0)
        b = max(1, min(8, 1 + floor((a - 19723) * 8 / 180)))
        newest[b] = max(newest.get(b, s), s)
        cents = floor(100 * amount + 0.5) if amount is not None else quantity * floor(100 * price[item] + 0.5) if quantity is not None and price.get(item) is not None else 0
        placed.append((a, b, s, nation.get(vendor), item, -cents if flag == "swapped" else cents))
    revenue, boards, out = {}, {}, set()
    for day in sorted({x[0] for x in placed}):
        for a, b, s, n, item, cents in placed:
            if a == day and n is not None and item in price and all(s + 15 >= newest[k] for k in newest if k < b):
                revenue[n, item] = revenue.get((n, item), 0) + cents
        batch = next(x[1] for x in placed if x[0] == day)
        for n in {k for k, _ in revenue}:
            best = sorted((-v, i) for (m, i), v in revenue.items() if m == n and v > 0)[:10]
            old, new = boards.get(n, {}), {i: k for k, (_, i) in enumerate(best, 1)}
            for i in old.keys() | new.keys():
                if old.get(i) != new.get(i):
                    out.add((n, day, i, batch, "enter" if i not in old else "exit" if i not in new else "move", old.get(i), new.get(i), revenue[n, i]))
            boards[n] = new
    return out


def rows_of(df):
    return {tuple(r) for r in df.select("nation_id", "arrival_day", "item_id", "batch", "change", "old_rank", "new_rank", "revenue").collect()}


def test_feed(spark):
    """A hot vendor and item, ties, repeated, late and null rows, unknown items and vendors, a clashing column."""
    rng = random.Random(4)
    maybe = lambda x: None if rng.random() < 0.06 else x
    lines = []
    for k in range(600):
        at = datetime(2024, 1, 1) + timedelta(days=int(140 * rng.random()), hours=rng.randint(0, 23))
        lines.append((k // 3, maybe(k % 3), maybe(rng.choice([1, 1, *range(30)])), maybe(rng.choice([0, 0, *range(9)])), maybe(rng.randint(1, 5)), maybe(rng.choice([1.0, 2.5, 9.99])), 0.0, maybe(rng.choice(["kept", "swapped", "returned"])), maybe(at), "x"))
    lines += lines[:20]
    nation, price = {v: (v % 3 if v < 7 else None) for v in range(8)}, {i: None if i == 5 else 0.5 + i for i in range(27)}
    frames = (spark.createDataFrame(lines, LINES), spark.createDataFrame([(v, "", n, 0.0) for v, n in nation.items()], VENDORS), spark.createDataFrame([(i, "", p) for i, p in price.items()], ITEMS))
    got = leaderboard.fed(leaderboard.lines_of(*frames, Store(spark, "t")).withColumn("shard", leaderboard.F.col("shard") % 3), Store(spark, "t"))
    want = plain(lines, nation, price)
    assert rows_of(got) == want and got.count() == len(want) > 100


def test_empty_table(spark):
    frames = (spark.createDataFrame([], LINES), spark.createDataFrame([], VENDORS), spark.createDataFrame([], ITEMS))
    assert leaderboard.fed(leaderboard.lines_of(*frames, Store(spark, "t")), Store(spark, "t")).count() == 0


def test_matches_sql(spark):
    folder = "/root/testdata/sf0.001"
    for t in ("sale_lines", "vendors", "items"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = duckdb.sql(f"SELECT nation_id, arrival_day, item_id, batch, change, old_rank, new_rank, revenue FROM ({leaderboard.ORACLE_SQL})").fetchall()
    assert rows_of(leaderboard.query(spark, folder)) == set(want)


class Held:
    """Map and value state without Spark."""

    def __init__(self, *_):
        self.map, self.value = {}, None

    getMapState = getValueState = lambda self, *_: Held()

    def iterator(self):
        return iter(self.map.items())

    def updateValue(self, key, value):
        self.map[key] = value

    def removeKey(self, key):
        self.map.pop(key, None)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


@pytest.mark.parametrize("stretch", [1, 30, 10_000])
@pytest.mark.parametrize(("n_items", "n_rows", "days"), [(5, 3, 1), (30, 40, 20), (200, 600, 5), (200, 600, 20)])
def test_processors_against_a_plain_replay(monkeypatch, stretch, n_items, n_rows, days):
    """Few and many items, falling and negative revenues, small chunks of state, short and long stretches of days."""
    monkeypatch.setattr(leaderboard, "STRETCH", stretch)
    monkeypatch.setattr(leaderboard, "CHUNK", 50)
    for seed in range(4):
        rng = np.random.default_rng(seed)
        shards, nation = [leaderboard.ShardBoards() for _ in range(4)], leaderboard.NationBoard()
        for x in (*shards, nation):
            x.init(Held())
        revenue, board, want, got = {}, [], [], []
        for batch in range(1, 5):
            item, day, cents = rng.integers(0, n_items, n_rows), rng.integers((batch - 1) * days, batch * days, n_rows), np.floor(rng.normal(100, 400, n_rows))
            told = []
            for k, shard in enumerate(shards):
                if (mine := item % 4 == k).any():
                    frame = pd.DataFrame({"item_id": item[mine], "arrival_day": day[mine], "batch": batch, "cents": cents[mine]})
                    told += shard.handleInputRows((1, k), iter([frame.iloc[:1], frame.iloc[1:]]), None)
            if told:
                for f in nation.handleInputRows((1,), iter(told), None):
                    got += [tuple(None if pd.isna(v) else v if isinstance(v, str) else int(v) for v in r) for r in f.itertuples(index=False)]
            for d in range((batch - 1) * days, batch * days):
                for i, c in zip(item[day == d].tolist(), cents[day == d].tolist(), strict=True):
                    revenue[i] = revenue.get(i, 0) + c
                best = [i for _, i in sorted((-v, i) for i, v in revenue.items() if v > 0)[:10]]
                old, new = ({i: n for n, i in enumerate(x, 1)} for x in (board, best))
                want += [(1, d, i, batch, "enter" if i not in old else "exit" if i not in new else "move", old.get(i), new.get(i), int(revenue[i])) for i in old.keys() | new.keys() if old.get(i) != new.get(i)]
                board = best
        assert len(got) == len(want) and set(got) == set(want)


def test_lines_are_not_sorted_for_their_joins(spark):
    from trailmill.llm.leaderboard import lines_of
    from trailmill.plans.shared_store import Store
    from trailmill.sources.tables import table

    lines = lines_of(*(table(spark, "/root/testdata/sf0.001", t) for t in ("sale_lines", "vendors", "items")), Store(spark, "t"))
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan
