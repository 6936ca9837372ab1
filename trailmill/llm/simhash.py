"""SimHash near-duplicates: 64-bit fingerprints linked by a self-join over binary tries.

1. ``fingerprints``: one pass over whole texts, Arrow batches in, (row, fingerprint) out.
2. ``trie_links``: equal fingerprints collapse first. Fingerprints that differ in at most ``errors`` bits agree in
   one of ``errors + 1`` blocks of bits, so each is sent to one bucket per block. Within a bucket the remaining
   bits form a binary trie; pairs of nodes are walked together from the root, differing bits are added up, and a
   pair is dropped once it exceeds the budget. Buckets above ``bucket_rows`` are dealt again by the same argument
   over their remaining bits: no bucket is cut off and none has to fit one task.
3. ``components``: alternating star contraction over the links, in rounds of joins with a written table each.

Only a spanning forest of the links of a batch leaves a task, so a group of k near copies yields k - 1 rows.

``similar`` is the operator for a bound on the similarity of shingle sets instead of bits. At a Jaccard similarity of
0.8 about ten of 64 bits differ, and no split of 64 bits into blocks finds that; so buckets come from MinHash bands of
the same shingle hashes (a pair at 0.8 shares none of 20 bands of four with probability (1 - 0.8^4)^20 < 3e-5), the
tries of a bucket are walked with a budget of 24 bits, and the whole sets of what is left decide. A bucket of more than
``FEW`` different sets does not form its pairs: every set is compared with the bucket's hub, the one closest to the
majority of the bucket's fingerprints. A set that is not similar to its hub is then compared with those sets of the same
hub that are not joined to it yet and that it can be similar to: two sets share none of the hub's shingles that either
lacks, and none that only one set of this hub has, which bounds their similarity before they are compared. So no pair of a
bucket that could join two components is left out, and a group of k near copies costs about k pairs.

Defined results: null and empty texts have fingerprint zero (the empty set) and link like any other; repeated rows share
a component; a null id takes part in links and never becomes a component's name unless all its ids are null; a text of
fewer words than a shingle is its own only shingle; a very long text is hashed whole in steps of bounded memory; an
empty table gives no rows; columns other than key and text are not read, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.plans.shared_store import Store, small
from trailmill.sources.tables import table

ORACLE_SQL = None
_BITS = 64


#: ``similar``: words of a shingle, similarity, bits that may differ, bands and their rows, sets of a bucket whose pairs are all walked.
WIDTH, SIMILARITY, WIDE, BANDS, ROWS, FEW = 5, 0.8, 24, 20, 4, 16
BROADCAST_ROWS = 500_000
_DRAWN = np.random.default_rng(42)
_MULTIPLY = _DRAWN.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COMBINE = _DRAWN.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """Hashes (uint64) of the word shingles of a UTF-8 text in turn."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width])).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))


def majority(h: np.ndarray) -> int:
    """Bit b is 1 if set in over half the hashes."""
    ones = np.zeros(_BITS, np.int64)
    for k in range(0, len(h), 4096):
        ones += np.unpackbits(h[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def simhash(text: bytes, width: int = 3) -> int:
    """Fingerprint of a UTF-8 text: bit b is 1 if set in over half the hashes of its word shingles, repeats included."""
    return majority(shingle_hashes(text, width))


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``fp`` (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).cast(pa.large_binary())
            fp = np.fromiter((simhash(t.as_py() or b"") for t in texts), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp)], names=[*keep, "fp"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "fp long"]))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component, over links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(up := root[root], root):
            root = up
        left = root[a] != root[b]
        a, b = a[left], b[left]
    return root


def trie_pairs(fp: np.ndarray, bucket: np.ndarray, errors: int, at_once: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (a, b), a < b, of fingerprints of one bucket that differ in at most ``errors`` bits.

    ``fp`` (uint64) is sorted within each bucket and has no repeats there; ``bucket`` is sorted. A trie node is a
    range of positions that share a prefix; a pair of nodes carries the bits that differ so far.
    """
    edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    lo, hi = edge[:-1], edge[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    stack = [(lo[k : k + at_once], hi[k : k + at_once], lo[k : k + at_once], hi[k : k + at_once], np.zeros(len(lo[k : k + at_once]), np.int8), _BITS - 1) for k in range(0, len(lo), at_once)]
    while stack:
        a0, a1, b0, b1, cost, bit = stack.pop()
        # Pairs with few leaves are compared outright, the others go down a level.
        done = ((a1 - a0) * (b1 - b0) <= 16) | (bit < 0)
        if done.any():
            yield from _leaves(fp, a0[done], a1[done], b0[done], b1[done], errors, at_once)
        a0, a1, b0, b1, cost = (x[~done] for x in (a0, a1, b0, b1, cost))
        if not len(a0):
            continue
        am, bm = _split(fp, a0, a1, bit), _split(fp, b0, b1, bit)
        same = a0 == b0
        kids = []
        for x0, x1, y0, y1, more in ((a0, am, b0, bm, 0), (am, a1, bm, b1, 0), (a0, am, bm, b1, 1), (am, a1, b0, bm, 1)):
            ok = (x1 > x0) & (y1 > y0) & (cost + more <= errors)
            if more and x0 is am:
                ok &= ~same  # of a node with itself one mixed pair is enough
            ok &= ~((x0 == y0) & (x1 - x0 == 1) & (y1 - y0 == 1))
            kids.append((x0[ok], x1[ok], y0[ok], y1[ok], (cost[ok] + more).astype(np.int8)))
        parts = [np.concatenate(x) for x in zip(*kids, strict=True)]
        stack += [(*(x[k : k + at_once] for x in parts), bit - 1) for k in range(0, len(parts[0]), at_once)]


def _split(fp: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """The first position in [lo, hi) whose ``bit`` is 1, by bisection of all ranges together."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        one = ((fp[np.minimum(mid, len(fp) - 1)] >> np.uint64(bit)) & np.uint64(1)).astype(bool)
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def _leaves(fp, a0, a1, b0, b1, errors, at_once):
    for k in range(0, len(a0), at_once):
        x0, y0, ny = a0[k : k + at_once], b0[k : k + at_once], (b1 - b0)[k : k + at_once]
        size = (a1 - a0)[k : k + at_once] * ny
        owner = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        a, b = x0[owner] + place // ny[owner], y0[owner] + place % ny[owner]
        ok = (a < b) & (np.bitwise_count(fp[a] ^ fp[b]) <= errors)
        yield a[ok], b[ok]


def trie_links(fp: DataFrame, errors: int, store: Store, bucket_rows: int = 4096, flush: int = 200_000) -> DataFrame:
    """(a, b) node links between rows (node long, fp long), fp unique: a spanning forest per bucket batch."""
    # taken: mask of the bits that the bucket fixes; value: those bits. Both name the bucket.
    level = fp.select("node", "fp", F.lit(0).cast("long").alias("taken"))
    ready = None
    for depth in range(3):
        masks = _masks(depth, errors)
        dealt = level.select("node", "fp", F.explode(_next_masks(masks, F.col("taken"))).alias("taken"))
        dealt = dealt.select("node", "fp", "taken", F.xxhash64("taken", F.col("fp").bitwiseAND(F.col("taken"))).alias("bucket"))
        if depth == 2:
            small_part, level = dealt, None
        else:
            dealt = store.put(dealt)
            sizes = dealt.groupBy("bucket").agg(F.count("*").alias("n"))
            large = store.put(sizes.where(F.col("n") > bucket_rows).select("bucket"))
            if large.limit(1).count() == 0:
                small_part, level = dealt, None
            else:
                small_part = dealt.join(large, "bucket", "left_anti")
                level = dealt.join(large, "bucket", "left_semi").select("node", "fp", "taken")
        ready = small_part if ready is None else ready.unionByName(small_part)
        if level is None:
            break

    def forest(node: np.ndarray, f: np.ndarray, group: np.ndarray) -> pa.RecordBatch | None:
        end = len(node)
        tree, found, size = np.arange(end), [], 0
        for a, b in trie_pairs(f, group, errors):
            found.append((a, b))
            size += len(a)
            if size >= 1 << 20:
                tree, found, size = _roots(end, *(np.concatenate(x) for x in zip(*found, (np.arange(end), tree), strict=True))), [], 0
        tree = _roots(end, *(np.concatenate(x) for x in zip(*found, (np.arange(end), tree), strict=True)))
        moved = np.flatnonzero(tree != np.arange(end))
        return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[tree[moved]])], names=["a", "b"]) if len(moved) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, f, group in _whole_buckets(batches, flush):
            if (out := forest(node, f, group)) is not None:
                yield out

    near = ready.select("node", "fp", "bucket").repartition("bucket").sortWithinPartitions("bucket", "fp")
    return near.mapInArrow(run, "a long, b long")


def _whole_buckets(batches: Iterator[pa.RecordBatch], flush: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows (node, fp, bucket, more) sorted by bucket and fp in pieces of about ``flush`` rows; a bucket is never cut.
    Yields (node, fp as uint64, number of the bucket, more) in that order."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0

    def cut(whole: bool) -> tuple[np.ndarray, ...] | None:
        nonlocal held, n
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        bucket = columns[2]
        edge = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
        end = len(bucket) if whole else int(edge[-1]) if len(edge) else 0
        held, n = ([tuple(c[end:] for c in columns)] if end < len(bucket) else []), len(bucket) - end
        if not end:
            return None
        node, f, bucket, *more = (c[:end] for c in columns)
        order = np.lexsort((f, bucket))
        return (node[order], f[order], np.unique(bucket[order], return_inverse=True)[1], *(c[order] for c in more))

    for x in batches:
        held.append((x.column(0).to_numpy(), x.column(1).to_numpy().view(np.uint64), *(x.column(k).to_numpy() for k in range(2, x.num_columns))))
        n += x.num_rows
        if n >= flush and (out := cut(False)) is not None:
            yield out
    if held and (out := cut(True)) is not None:
        yield out


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    return [x.tolist() for x in np.array_split(np.array(bits), parts)]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def _masks(depth: int, errors: int) -> dict[int, list[int]]:
    """Of each mask of fixed bits at this depth, the masks below it: those bits and one block of the others."""
    level = {0: list(range(_BITS))}
    for d in range(depth + 1):
        below: dict[int, list[int]] = {}
        out: dict[int, list[int]] = {}
        for taken, rest in level.items():
            for block in _blocks(rest, errors + 1):
                fixed = [b for b in range(_BITS) if b not in rest] + block
                m = _mask(fixed)
                out.setdefault(taken, []).append(m)
                below[m] = [b for b in rest if b not in block]
        level = below
        if d == depth:
            return out
    return {}


def _next_masks(masks: dict[int, list[int]], taken):
    out = None
    for m, below in masks.items():
        values = F.array(*[F.lit(x).cast("long") for x in below])
        out = F.when(taken == m, values) if out is None else out.when(taken == m, values)
    return out


def components(links: DataFrame, store: Store) -> DataFrame:
    """(node, root): the least node of each component, for every node that has a link. Links: columns a, b.

    Alternating large-star and small-star steps, until the links are stars; a round keeps at most as many links as
    there were, and rounds grow with the logarithm of the longest chain.
    """
    links = store.put(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while not _stars(links):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = store.put(large.where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small_ = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))).alias("x")).select("x.a", "x.b")
        after = store.put(small_.where("a <> b").distinct())
        store.drop(large)
        store.drop(links)
        links = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _stars(links: DataFrame) -> bool:
    """Whether every node has one link down at most, and none that has one is itself linked to."""
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x"))
    return ends.groupBy("x.n").agg(F.sum("x.up").alias("up"), F.max("x.down").alias("down")).where("up > 1 OR up > 0 AND down > 0").limit(1).count() == 0


def clustered(docs: DataFrame, store: Store, errors: int = 3, key: str = "doc_id") -> DataFrame:
    """(key, fp, component): rows of ``docs`` (key, text) with the least key that is reachable by links."""
    fps = store.put(fingerprints(docs, keep=(key,)))
    # Rows without a key take part under a node above all keys.
    nodes = store.put(fps.groupBy("fp").agg(F.coalesce(F.min(key), F.xxhash64("fp").bitwiseOR(F.lit(1 << 62))).cast("long").alias("node")))
    links = trie_links(nodes, errors, store)
    named = nodes.join(components(links, store), "node", "left").select("fp", F.coalesce("root", "node").alias("component"))
    return fps.join(named, "fp")


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key (int64) per band of a set's hashes: the minima of its rows under ``ROWS`` orders, combined."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 1024):
        mixed = hashes[k : k + 1024, None] * _MULTIPLY
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(low, mixed.min(axis=0), out=low)
    keys = (low.reshape(BANDS, ROWS) * _COMBINE).sum(axis=1, dtype=np.uint64)
    keys ^= keys >> np.uint64(29)
    return (keys * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _sketched(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sig, n, fp, bands): hash and size of the set of shingles, its fingerprint and its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).cast(pa.large_binary()):
                h = np.unique(shingle_hashes(t.as_py() or b"", WIDTH))
                rows.append((xxhash.xxh64_intdigest(h.tobytes(), 7), len(h), majority(h), band_keys(h)))
            sig, n, fp, bands = zip(*rows, strict=True) if rows else ((), (), (), ())
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), signed(sig), pa.array(n, pa.int32()), signed(fp), pa.array(bands, pa.list_(pa.int64()))], names=["key", "sig", "n", "fp", "bands"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, sig long, n int, fp long, bands array<long>")


def _sets(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """(sig, x): the sorted shingle hashes of the sets in ``wanted`` (sig, key), from whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                texts = b.column(1).slice(k, 500).cast(pa.large_binary())
                sets = [np.unique(shingle_hashes(t.as_py() or b"", WIDTH)).view(np.int64) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 500), pa.array(sets, pa.list_(pa.int64()))], names=["sig", "x"])

    wanted = F.broadcast(wanted) if small(wanted, BROADCAST_ROWS) else wanted
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).join(wanted, "key").select("sig", "text").mapInArrow(run, "sig long, x array<long>")


def _fit(n, m):
    return F.least(n, m) >= SIMILARITY * F.greatest(n, m) - 1e-9


def _walked(cells: DataFrame) -> DataFrame:
    """(a, b): pairs of a bucket (cells: sig, fp, bucket, n) that the tries leave and whose sizes allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sig, f, group, size in _whole_buckets(batches, 100_000):
            for a, b in trie_pairs(f, group, WIDE):
                ok = np.minimum(size[a], size[b]) >= SIMILARITY * np.maximum(size[a], size[b]) - 1e-9
                a, b = sig[a[ok]], sig[b[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return cells.select("sig", "fp", "bucket", "n").repartition("bucket").sortWithinPartitions("bucket", "fp").mapInArrow(run, "a long, b long")


def _mask_of(hashes, k: int):
    """64 bits, one set for each hash of the k-th quarter: the bits set are at most as many as the hashes."""
    mine = F.filter(hashes, lambda e: F.shiftright(e, 6).bitwiseAND(F.lit(3)) == k)
    return F.aggregate(mine, F.lit(0).cast("long"), lambda acc, e: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), e.bitwiseAND(F.lit(63)).cast("int"))))


def similar(docs: DataFrame, store: Store, key: str, text: str = "text") -> DataFrame:
    """(key, component) of every row of ``docs``, alike for rows joined by links of ``SIMILARITY`` or more. key: a unique long."""
    sketched = store.put(_sketched(docs, key, text))
    once = store.put(sketched.groupBy("sig").agg(F.min("key").alias("key"), F.min(F.struct("n", "fp", "bands")).alias("s")))
    cells = store.put(once.select("sig", "s.n", "s.fp", F.explode("s.bands").alias("bucket")))
    sized = store.put(cells.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"))
    met = store.put(cells.join(sized, "bucket"))
    sets = store.put(_sets(docs, key, text, store.put(once.select("sig", "key").join(met.select("sig").distinct(), "sig", "left_semi"))))

    def with_sets(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("sig").alias("a"), "x"), "a").join(sets.select(F.col("sig").alias("b"), F.col("x").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        return both.withColumn("linked", shared >= SIMILARITY * (F.size("x") + F.size("y") - shared) - 1e-9)

    close = lambda f, g: F.bit_count(F.col(f).bitwiseXOR(F.col(g))) <= WIDE
    links = store.put(with_sets(_walked(met.where(F.col("c") <= FEW)).distinct()).where("linked").select("a", "b"))
    large = met.where(F.col("c") > FEW)
    if not large.limit(1).count():
        return _named(sketched, store.put(components(links, store)), key)

    # Of every large bucket the set closest to the majority of its fingerprints, and all others against it.
    bit = lambda k: F.when(2 * F.sum(F.shiftrightunsigned("fp", k).bitwiseAND(F.lit(1))) > F.count("*"), F.lit(-(1 << 63) if k == 63 else 1 << k)).otherwise(0)
    centre = large.groupBy("bucket").agg(reduce(lambda x, y: x.bitwiseOR(y), [bit(k) for k in range(_BITS)]).alias("centre"))
    near = large.join(centre, "bucket").groupBy("bucket").agg(F.min(F.struct(F.bit_count(F.col("fp").bitwiseXOR(F.col("centre"))).alias("d"), "sig"))["sig"].alias("hub"))
    star = large.join(near, "bucket").where("sig <> hub").select(F.col("hub").alias("a"), F.col("sig").alias("b"), "fp").distinct()
    lacks = F.array_except("x", "y")
    against = with_sets(star).select(F.col("a").alias("hub"), F.col("b").alias("sig"), "fp", F.size("x").alias("of"), F.size("y").alias("n"), "linked", F.array_except("y", "x").alias("more"), F.array(*[_mask_of(lacks, k) for k in range(4)]).alias("lacks"))
    against = store.put(against)
    links = store.put(links.unionByName(against.where("linked").select(F.least("hub", "sig").alias("a"), F.greatest("hub", "sig").alias("b"))))
    roots = store.put(components(links, store))
    alone = against.select("hub", "sig", F.explode("more").alias("e")).groupBy("hub", "e").agg(F.count("*").alias("k"), F.min("sig").alias("sig")).where("k = 1").groupBy("hub", "sig").agg(F.count("*").alias("u"))
    group = against.join(alone, ["hub", "sig"], "left").join(roots, F.col("sig") == F.col("node"), "left")
    # own: shingles that the hub lacks and another set of this hub has.
    group = store.put(group.select("hub", "sig", "fp", "of", "n", "linked", "lacks", (F.size("more") - F.coalesce("u", F.lit(0))).alias("own"), F.coalesce("root", "sig").alias("root")))
    apart = group.where(~F.col("linked")).select("hub", F.col("sig").alias("other"), F.col("fp").alias("g"), F.col("n").alias("m"), F.col("own").alias("more"), F.col("lacks").alias("without"), F.col("root").alias("over"))
    lacking = reduce(lambda x, y: x + y, [F.bit_count(F.col("lacks")[k].bitwiseOR(F.col("without")[k])) for k in range(4)])
    most = F.least("n", "m", F.col("of") - lacking + F.least("own", "more"))
    able = most >= SIMILARITY * (F.col("n") + F.col("m") - most) - 1e-9
    pairs = group.join(apart, "hub").where((F.col("root") != F.col("over")) & (F.col("linked") | (F.col("sig") < F.col("other"))) & able & close("fp", "g"))
    pairs = store.put(pairs.select(F.least("sig", "other").alias("a"), F.greatest("sig", "other").alias("b")).distinct())
    if pairs.limit(1).count():
        found = with_sets(pairs).where("linked").select("a", "b")
        roots = store.put(components(found.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), store))
    return _named(sketched, roots, key)


def _named(sketched: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    roots = F.broadcast(roots) if small(roots, BROADCAST_ROWS) else roots
    return sketched.join(roots, sketched["sig"] == roots["node"], "left").select(F.col("key").alias(key), F.coalesce("root", "sig").alias("component"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = clustered(docs, Store(spark, "simhash"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select("doc_id", digits.alias("fingerprint"), F.col("component").alias("component_id"))
