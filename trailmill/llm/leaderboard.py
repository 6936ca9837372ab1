"""Change feed of leaderboards: who enters, leaves or moves on each nation's board of the highest running revenues.

Lines arrive in numbered batches. Each batch is put into one feed folder and the same stateful streaming query is
started anew for it on one checkpoint. Within the query

1. every input split sums its lines by nation, item and arrival day, so that a hot item is a few rows before the exchange;
2. ``ShardBoards`` (keyed by nation and a hash shard of its items) holds the running revenues in a ``MapState``, replays
   the days in order on a list that ``bisect`` keeps ordered by (-revenue, item), and passes on what changed among the
   shard's first places, since only those can be among the nation's. The list holds the items that can come among the first
   at all: an item whose highest revenue within a stretch of days lies below what ten items never fall below cannot;
3. ``NationBoard`` (keyed by nation) holds those candidates' revenues in a ``MapState`` and the saved board in a
   ``ValueState``, replays the days in the same way and gives the differences between a board and the one before.

A nation with a third of all lines is dealt over ``SHARDS`` keys in step 2, and what reaches its one key in step 3 is at
most 20 rows for each shard and day, whatever the input. A map entry holds the revenues of a chunk of items, since a call
to the state server for each item would cost more than the work. State, offsets and results are committed for each
batch by Spark, so a lost executor or driver repeats one batch at most.

Defined results: lines without nation or known item are ignored (but count for lateness); repeated lines add up; null
amounts and quantities as in ``lines_of``; ties go to the smaller item; revenues of zero or less are on no board; days
before the first batch's belong to it; vendors or items that occur twice count with their smallest nation and largest
price; an empty table gives no rows; other columns are not read, so no name can clash.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trailmill.plans.shared_store import Store
from trailmill.sources.tables import table
from trailmill.streaming.stateful import Feed

BATCHES = 8
FIRST_DAY, DAYS = 19723, 180
LATENESS = 15
PLACES = 10
#: Items of a nation are dealt over this many state keys, and over one more for every so many items.
SHARDS, ITEMS_A_SHARD = 32, 50_000
#: Items of a map entry lie within so many ids; of one shard's, that is a thousand or two.
CHUNK = 65_536
#: Rows of a stretch of days, about, over which items are left aside together.
STRETCH = 400

LINES = "nation_id int, item_id long, day long, arrival_day long, batch int, cents double, shard int"
PARTIAL = "nation_id int, shard int, item_id long, arrival_day long, batch int, cents double"
CANDIDATES = "nation_id int, arrival_day long, item_id long, batch int, cents double, placed boolean"
CHANGES = "nation_id int, arrival_day long, item_id long, batch int, change string, old_rank int, new_rank int, revenue long"


class Order:
    """Revenues of items, and the positive ones in order: a list of (-revenue, item) that ``bisect`` keeps."""

    def __init__(self, cents: dict[int, float]):
        self.cents = cents
        self.order = sorted((-v, k) for k, v in cents.items() if v > 0)

    def put(self, item: int, cents: float | None) -> None:
        """A new revenue; None forgets the item."""
        old = self.cents.get(item, 0.0)
        if old > 0:
            del self.order[bisect_left(self.order, (-old, item))]
        if cents is None:
            self.cents.pop(item, None)
            return
        self.cents[item] = cents
        if cents > 0:
            insort(self.order, (-cents, item))

    def first(self, places: int) -> list[int]:
        return [item for _, item in self.order[:places]]


def loaded(state) -> tuple[np.ndarray, np.ndarray]:
    """(items, revenues) of a ``MapState`` from chunk number to both, in the order of the items."""
    held = [value for _, value in state.iterator()]
    items = np.frombuffer(b"".join(bytes(x) for x, _ in held), "<i8")
    cents = np.frombuffer(b"".join(bytes(x) for _, x in held), "<f8")
    order = np.argsort(items)
    return items[order], cents[order]


def saved(state, items: np.ndarray, cents: np.ndarray, touched: np.ndarray) -> None:
    """Writes the chunks of the touched items. items: in order, and all that are held."""
    for chunk in np.unique(touched // CHUNK).tolist():
        a, b = np.searchsorted(items, (chunk * CHUNK, (chunk + 1) * CHUNK))
        if a < b:
            state.updateValue((chunk,), (items[a:b].astype("<i8").tobytes(), cents[a:b].astype("<f8").tobytes()))
        else:
            state.removeKey((chunk,))


def _gathered(rows: Iterator[pd.DataFrame], names: list[str]) -> list[np.ndarray]:
    """Columns of a key's rows in the order of day and item."""
    frames = [x[names] for x in rows]
    joined = pd.concat(frames) if len(frames) > 1 else frames[0]
    columns = [joined[c].to_numpy() for c in names]
    order = np.lexsort((columns[0], columns[1]))
    return [c[order] for c in columns]


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where rows with other values begin, and the end."""
    differs = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        differs |= c[1:] != c[:-1]
    return np.concatenate(([0], np.flatnonzero(differs) + 1, [len(columns[0])]))


class ShardBoards(StatefulProcessor):
    """(nation, shard): the changes among the shard's first places, by day."""

    def __init__(self, places: int = PLACES):
        self.places = places

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.revenues = handle.getMapState("revenues", "chunk long", "items binary, cents binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        item, day, batch, added = _gathered(rows, ["item_id", "arrival_day", "batch", "cents"])
        edge = _edges(item, day)[:-1]
        added = np.add.reduceat(added, edge)
        item, day, batch = item[edge], day[edge], batch[edge]
        known, held = loaded(self.revenues)
        items = np.union1d(known, item)
        cents = np.zeros(len(items))
        cents[np.searchsorted(items, known)] = held
        place = np.searchsorted(items, item)
        out: list[tuple] = []
        begins = _edges(day)
        a = 0
        while a < len(day):
            b = int(begins[min(np.searchsorted(begins, a + STRETCH), len(begins) - 1)])
            self._replayed(key[0], items, cents, place[a:b], day[a:b], batch[a:b], added[a:b], out)
            a = b
        saved(self.revenues, items, cents, item)
        if out:
            yield pd.DataFrame(out, columns=[f.split()[0] for f in CANDIDATES.split(", ")])

    def _replayed(self, nation, items, cents, place, day, batch, added, out) -> None:
        """Some days in a row; ``cents`` is brought to the end of the last one."""
        order = np.lexsort((day, place))
        sums, first = np.cumsum(added[order]), _edges(place[order])[:-1]
        before = np.repeat(sums[first] - added[order][first], np.diff(np.append(first, len(order))))
        running = np.empty(len(order))
        running[order] = cents[place[order]] + sums - before
        least, most = cents.copy(), cents.copy()
        np.minimum.at(least, place, running)
        np.maximum.at(most, place, running)
        # Ten items are never below this in these days, so what is never that high is never among the ten.
        bound = max(0.0, np.partition(least, -self.places)[-self.places]) if len(least) >= self.places else 0.0
        may = (most >= bound) & (most > 0)
        board = Order(dict(zip(items[may].tolist(), cents[may].tolist(), strict=True)))
        old = {i: board.cents[i] for i in board.first(self.places)}
        use = may[place]
        who, when, which, value = items[place[use]].tolist(), day[use], batch[use].tolist(), running[use].tolist()
        edges = _edges(when).tolist() if len(when) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            for k in range(a, b):
                board.put(who[k], value[k])
            now = {i: board.cents[i] for i in board.first(self.places)}
            at = int(when[a])
            out += [(nation, at, i, which[a], x, True) for i, x in now.items() if old.get(i) != x]
            out += [(nation, at, i, which[a], board.cents[i], False) for i in old if i not in now]
            old = now
        np.add.at(cents, place, added)

    def close(self) -> None:
        pass


class NationBoard(StatefulProcessor):
    """nation: the differences between each day's board and the one before."""

    def __init__(self, places: int = PLACES):
        self.places = places

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.candidates = handle.getMapState("candidates", "chunk long", "items binary, cents binary")
        self.board = handle.getValueState("board", "items array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        items, day, batch, cents, placed = _gathered(rows, ["item_id", "arrival_day", "batch", "cents", "placed"])
        known, amounts = loaded(self.candidates)
        held, out = Order(dict(zip(known.tolist(), amounts.tolist(), strict=True))), []
        before = [int(x) for x in self.board.get()[0]] if self.board.exists() else []
        item, cents, batch, placed, edges = items.tolist(), cents.tolist(), batch.tolist(), placed.tolist(), _edges(day).tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            afterwards = {item[k]: cents[k] for k in range(a, b)}
            for k in range(a, b):
                held.put(item[k], cents[k] if placed[k] else None)
            now = held.first(self.places)
            old, new = ({i: n for n, i in enumerate(x, 1)} for x in (before, now))
            for i in old.keys() | new.keys():
                if old.get(i) != new.get(i):
                    change = "enter" if i not in old else "exit" if i not in new else "move"
                    revenue = afterwards[i] if i in afterwards else held.cents[i]
                    out.append((key[0], int(day[a]), i, batch[a], change, old.get(i), new.get(i), int(revenue)))
            before = now
        order = sorted(held.cents)
        saved(self.candidates, np.array(order, np.int64), np.array([held.cents[i] for i in order], np.float64), items)
        self.board.update((before,))
        if out:
            frame = pd.DataFrame(out, columns=[f.split()[0] for f in CHANGES.split(", ")])
            yield frame.astype({"old_rank": "Int32", "new_rank": "Int32"})

    def close(self) -> None:
        pass


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a split by nation, shard, item and day, about a million lines at a time."""
    keys = ["nation_id", "shard", "item_id", "arrival_day", "batch"]

    def sums(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        found = pa.Table.from_batches(held).group_by(keys).aggregate([("cents", "sum")])
        return found.rename_columns([*keys, "cents"]).combine_chunks().to_batches(max_chunksize=65_536)

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= 1_000_000:
            yield from sums(held)
            held, n = [], 0
    if n:
        yield from sums(held)


def boards(stream: DataFrame, places: int = PLACES) -> DataFrame:
    """``CHANGES`` of a stream of ``LINES`` whose batches come in the order of their days."""
    parts = stream.select("nation_id", "shard", "item_id", "arrival_day", "batch", "cents").mapInArrow(_summed, PARTIAL)
    shards = parts.groupBy("nation_id", "shard").transformWithStateInPandas(ShardBoards(places), CANDIDATES, "append", "none")
    return shards.groupBy("nation_id").transformWithStateInPandas(NationBoard(places), CHANGES, "append", "none")


def fed(lines: DataFrame, store: Store, batches: int = BATCHES, lateness: int = LATENESS, places: int = PLACES) -> DataFrame:
    """``CHANGES`` of ``LINES``, fed batch by batch; lines whose day is more than ``lateness`` days below the largest of earlier
    batches are dropped. The lines are written once, by batch; what goes to the driver is one day a batch."""
    feed, largest = Feed(lines, store), None
    newest = {r["batch"]: r["d"] for r in feed.staged().groupBy("batch").agg(F.max("day").alias("d")).collect()}
    for batch in feed.batches(range(1, batches + 1)):
        known = F.col("nation_id").isNotNull() & F.col("item_id").isNotNull() & F.col("cents").isNotNull()
        on_time = F.lit(True) if largest is None else F.col("day") + lateness >= largest
        feed.start(lambda stream, use=known & on_time: boards(stream.where(use), places))
        largest = max(x for x in (largest, newest.get(batch)) if x is not None)
    return feed.results() if largest is not None else lines.sparkSession.createDataFrame([], CHANGES)


def _cents(amount: Column) -> Column:
    return F.floor(amount * 100 + 0.5).cast("double")


def lines_of(sale_lines: DataFrame, vendors: DataFrame, items: DataFrame, store: Store, batches: int = BATCHES) -> DataFrame:
    """``LINES`` of the shop's tables: one row per line, with null cents where the item is not known. Both small sides are
    shuffled, since they grow with the shop. They are made unique and written first: a join of plain exchanges is one
    whose hot partitions Spark can split. Lines are not sorted for it: a task hashes its part of the small side, a row a key, and hot keys
    make that no larger."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    h = F.crc32(F.concat_ws(",", text("sale_id"), text("item_id"), text("vendor_id"), text("line_no")).cast("binary"))
    lines = sale_lines.select("item_id", "vendor_id", "quantity", "amount", "flag", h.alias("h"), F.unix_date(F.to_date("shipped_at")).cast("long").alias("shipped"))
    lines = lines.withColumn("day", F.coalesce("shipped", FIRST_DAY + F.col("h") % 150))
    lines = lines.withColumn("arrival_day", F.col("day") + F.col("h") % 7 + F.when(F.col("h") % 5 == 0, 20).otherwise(0))
    batch = F.least(F.lit(batches), 1 + F.floor((F.col("arrival_day") - FIRST_DAY) * batches / DAYS))
    lines = lines.withColumn("batch", F.greatest(F.lit(1), batch).cast("int"))
    nations = store.put(vendors.groupBy("vendor_id").agg(F.min("nation_id").cast("int").alias("nation_id"))).hint("shuffle_hash")
    prices = store.put(items.groupBy("item_id").agg(F.max("price").alias("price"), F.lit(True).alias("known"))).hint("shuffle_hash")
    joined = lines.join(nations, "vendor_id", "left").join(prices, "item_id", "left")
    cents = F.coalesce(_cents(F.col("amount")), F.col("quantity") * _cents(F.col("price")), F.lit(0.0))
    cents = F.when(F.col("known"), F.when(F.col("flag") == "swapped", -cents).otherwise(cents))
    shards = SHARDS + prices.count() // ITEMS_A_SHARD
    return joined.select("nation_id", "item_id", "day", "arrival_day", "batch", cents.alias("cents"), F.pmod(F.xxhash64("item_id"), F.lit(shards)).cast("int").alias("shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, "leaderboard")
    return fed(lines_of(*(table(spark, sf_dir, t) for t in ("sale_lines", "vendors", "items")), store), store)


ORACLE_SQL = """
WITH coded AS (
  SELECT item_id, vendor_id, quantity, amount, flag, CAST(epoch(CAST(shipped_at AS DATE)) // 86400 AS BIGINT) AS shipped, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(concat(sale_id, ',', item_id, ',', vendor_id, ',', line_no), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda r, c: list_reduce([xor(r, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1) + z))) AS r
  FROM sale_lines),
dated AS (SELECT *, xor(r, 4294967295::BIGINT) AS h, coalesce(shipped, 19723 + xor(r, 4294967295::BIGINT) % 150) AS s FROM coded),
arrived AS (SELECT *, s + h % 7 + CASE WHEN h % 5 = 0 THEN 20 ELSE 0 END AS a FROM dated),
batched AS (SELECT *, greatest(1, least(8, 1 + CAST(floor((a - 19723) * 8 / 180) AS BIGINT))) AS b FROM arrived),
newest AS (SELECT b, max(s) AS m FROM batched GROUP BY b),
bounds AS (SELECT x.b, (SELECT max(y.m) FROM newest y WHERE y.b < x.b) AS m FROM newest x),
lines AS (
  SELECT v.nation_id, l.item_id, l.a, l.b, CASE WHEN l.flag = 'swapped' THEN -1 ELSE 1 END * coalesce(floor(100 * l.amount + 0.5), l.quantity * floor(100 * i.price + 0.5), 0) AS cents
  FROM batched l JOIN vendors v USING (vendor_id) JOIN items i ON i.item_id = l.item_id JOIN bounds USING (b)
  WHERE v.nation_id IS NOT NULL AND (bounds.m IS NULL OR l.s + 15 >= bounds.m)),
daily AS (SELECT nation_id, item_id, a, min(b) AS b, sum(cents) AS cents FROM lines GROUP BY ALL),
running AS (
  SELECT nation_id, item_id, a, sum(cents) OVER w AS revenue, lead(a) OVER w AS until
  FROM daily WINDOW w AS (PARTITION BY nation_id, item_id ORDER BY a)),
days AS (SELECT nation_id, a, min(b) AS b, row_number() OVER (PARTITION BY nation_id ORDER BY a) AS n FROM daily GROUP BY nation_id, a),
valued AS (SELECT d.nation_id, d.n, r.item_id, r.revenue FROM days d JOIN running r ON r.nation_id = d.nation_id AND r.a <= d.a AND (r.until IS NULL OR d.a < r.until)),
boards AS (SELECT *, row_number() OVER (PARTITION BY nation_id, n ORDER BY revenue DESC, item_id) AS rank FROM valued WHERE revenue > 0 QUALIFY rank <= 10),
changed AS (
  SELECT coalesce(o.nation_id, w.nation_id) AS nation_id, coalesce(o.n + 1, w.n) AS n, coalesce(o.item_id, w.item_id) AS item_id, o.rank AS old_rank, w.rank AS new_rank
  FROM boards o FULL JOIN boards w ON w.nation_id = o.nation_id AND w.n = o.n + 1 AND w.item_id = o.item_id
  WHERE o.rank IS DISTINCT FROM w.rank)
SELECT CAST(c.nation_id AS INTEGER) AS nation_id, CAST(d.a AS BIGINT) AS arrival_day, c.item_id, CAST(d.b AS INTEGER) AS batch,
  CASE WHEN c.old_rank IS NULL THEN 'enter' WHEN c.new_rank IS NULL THEN 'exit' ELSE 'move' END AS change,
  CAST(c.old_rank AS INTEGER) AS old_rank, CAST(c.new_rank AS INTEGER) AS new_rank, CAST(v.revenue AS BIGINT) AS revenue
FROM changed c JOIN days d ON d.nation_id = c.nation_id AND d.n = c.n JOIN valued v ON v.nation_id = c.nation_id AND v.n = c.n AND v.item_id = c.item_id
"""
