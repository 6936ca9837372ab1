"""A vector index on shared storage, kept under the version of its layout and the fingerprint of what it was made from.

Vectors are dealt to the pivot they point to most nearly, and each pivot's vectors lie in a folder of their own. For a pivot the index
holds how far from it its vectors lie at most and how long they are, which bounds every dot product with a query: so an
exact search reads the folders nearest to a query first, and then only those whose bound reaches its k-th score.

A run whose fingerprint is there reads the index and nothing else; otherwise it is built anew beside the old one, and counts as there
once its last table is whole. A half-written index is never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.functions.numeric import jround
from trailmill.operators.retrieval import best_products, matrix, top
from trailmill.plans.shared_store import exists, removed, subfolders

VERSION = "1"
#: Pivots go to every task and to the driver; beyond this many a pivot has more vectors instead, in parts.
MOST_PIVOTS = 4096
PART_ROWS = 16_384
QUERY_ROWS = 8192
#: Rows that are compared with all pivots at once.
_ROWS = 256


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start in range(0, b.num_rows, _ROWS):
            yield b.slice(start, _ROWS)


def digest(rows: DataFrame) -> str:
    """SHA-256 of a column's values as a bag, in any order: of the digests of 4096 groups of the values' own digests."""
    one = rows.select(F.sha2(F.coalesce(F.col(rows.columns[0]).cast("string"), F.lit("\0")), 256).alias("h"))
    groups = one.groupBy(F.substring("h", 1, 3).alias("g")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
    return groups.agg(F.sha2(F.coalesce(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), ""), F.lit("")), 256).alias("h")).first()["h"]


def file_fingerprint(df: DataFrame) -> str:
    """Of the names, sizes and times of a table's files: no value of the table is read."""
    return digest(df.select(F.concat_ws("|", "_metadata.file_path", F.col("_metadata.file_size"), F.unix_micros("_metadata.file_modification_time")).alias("f")).distinct())


@dataclass
class VectorIndex:
    spark: SparkSession
    folder: str
    schema: str
    built: bool

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, part int, pivot int").parquet(f"{self.folder}/vectors")

    def pivots(self) -> DataFrame:
        return self.spark.read.schema("pivot int, direction array<double>, closeness double, length double, n long").parquet(f"{self.folder}/pivots")


def _directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.linalg.norm(vectors, axis=1)
    return vectors / np.where(length > 0, length, 1)[:, None], length


def _nearest(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            direction, length = _directions(matrix(b.column("v"), pivots.shape[1]))
            close = direction @ pivots.T
            best = close.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best.astype(np.int32)), pa.array(close[np.arange(len(best)), best]), pa.array(length)], names=[*b.schema.names, "pivot", "_close", "_length"])

    return run


def opened(spark: SparkSession, folder: str, fingerprint: str, vectors: Callable[[], DataFrame], schema: str = "item_id long, v array<float>", part_rows: int = PART_ROWS) -> VectorIndex:
    """The index of this fingerprint, built from ``vectors()`` only if it is not there. schema: item_id, v (all of one width, no nulls) and
    whatever a search may filter by. Indexes of other fingerprints go once the new one is whole."""
    name = f"index-{VERSION}-{fingerprint[:40]}"
    index = VectorIndex(spark, f"{folder}/{name}", schema, False)
    if exists(spark, f"{index.folder}/pivots/_SUCCESS"):
        return index
    removed(spark, index.folder)
    names = [f.split()[0] for f in schema.split(", ")]
    rows = vectors().select(*names).where("v IS NOT NULL AND item_id IS NOT NULL")
    n = rows.count()
    wanted = min(MOST_PIVOTS, max(1, int(n**0.5)))
    chosen = rows.select("v", F.xxhash64("item_id").alias("h")).orderBy("h").limit(wanted).collect()
    if not n:
        rows.selectExpr("*", "0 AS part", "0 AS pivot").write.parquet(f"{index.folder}/vectors/pivot=0")
        spark.createDataFrame([], index_pivots()).write.parquet(f"{index.folder}/pivots")
        return VectorIndex(spark, index.folder, schema, True)
    directions, _ = _directions(np.array([r["v"] for r in chosen], np.float64))
    dealt = rows.mapInArrow(_nearest(directions), f"{schema}, pivot int, _close double, _length double")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(max(1, -(-n // (wanted * part_rows))))).cast("int"))
    dealt.drop("_close", "_length").repartition("pivot", "part").write.partitionBy("pivot").option("compression", "zstd").parquet(f"{index.folder}/vectors")
    # A pivot is given by its number alone, and how its vectors lie around it is summed up in the same tasks.
    around = dealt.groupBy("pivot").agg(F.min("_close").alias("closeness"), F.max("_length").alias("length"), F.count("*").alias("n"))
    named = spark.createDataFrame([(k, d.tolist()) for k, d in enumerate(directions)], "pivot int, direction array<double>")
    named.join(around, "pivot").select("pivot", "direction", "closeness", "length", "n").write.parquet(f"{index.folder}/pivots")
    for old in subfolders(spark, folder):
        if old.startswith("index-") and old != name:
            removed(spark, f"{folder}/{old}")
    return VectorIndex(spark, index.folder, schema, True)


def index_pivots() -> str:
    return "pivot int, direction array<double>, closeness double, length double, n long"


def _bounds(pivots: list) -> Callable:
    """Of queries: for each, all pivots with the most that a dot product with one of their vectors can be."""
    centre = np.array([p["direction"] for p in pivots], np.float64)
    reach, length = np.arccos(np.clip([p["closeness"] for p in pivots], -1, 1)), np.array([p["length"] for p in pivots])
    number, n = np.array([p["pivot"] for p in pivots], np.int32), np.array([p["n"] for p in pivots])

    def most(q: np.ndarray) -> np.ndarray:
        direction, size = _directions(q)
        apart = np.arccos(np.clip(direction @ centre.T, -1, 1)) - reach
        return np.maximum(np.cos(np.clip(apart, 0, np.pi)), 0) * length * size[:, None] + 1e-6

    def first(k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _pieces(batches):
                q = matrix(b.column("q"), centre.shape[1])
                order = np.argsort(-most(q), axis=1)
                take = (np.cumsum(n[order], axis=1) - n[order] < k).sum(axis=1)
                rows, at = np.repeat(np.arange(len(q)), take), np.concatenate([order[i, :t] for i, t in enumerate(take)]) if len(q) else []
                yield pa.RecordBatch.from_arrays([b.column("query_id").take(pa.array(rows)), b.column("q").take(pa.array(rows)), pa.array(number[at])], names=["query_id", "q", "pivot"])

        return run

    def rest(k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _pieces(batches):
                q = matrix(b.column("q"), centre.shape[1])
                bound = most(q)
                order = np.argsort(-bound, axis=1)
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(q), 0), 1)
                take = (np.cumsum(n[order], axis=1) - n[order] < k).sum(axis=1)
                rows, at = np.nonzero((place >= take[:, None]) & (bound >= b.column("floor").to_numpy()[:, None]))
                yield pa.RecordBatch.from_arrays([b.column("query_id").take(pa.array(rows)), b.column("q").take(pa.array(rows)), pa.array(number[at])], names=["query_id", "q", "pivot"])

        return run

    return first, rest


def search(index: VectorIndex, queries: DataFrame, k: int, threshold: float = 0.2, where: Column | None = None) -> DataFrame:
    """query_id, item_id, score, rank: exactly the best ``k`` by dot product, at least ``threshold``. queries: query_id, q. where: over the
    index's columns; a filter may leave the nearest folders with fewer than k hits, and the search then reads on."""
    spark = index.spark
    pivots = index.pivots().collect()
    out = "query_id long, item_id long, score double"
    if not pivots:
        return spark.createDataFrame([], f"{out}, rank long")
    first, rest = _bounds(pivots)
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.transform("q", lambda x: x.cast("double")).alias("q"))
    deals = max(1, -(-asked.count() // QUERY_ROWS))
    pairs = "query_id long, q array<double>, pivot int"
    deal = F.pmod(F.xxhash64("query_id"), F.lit(deals)).alias("deal")

    def found(wanted: DataFrame) -> DataFrame:
        """Hits of queries in the pivots they name; only those pivots' folders are read."""
        needed = [r["pivot"] for r in wanted.select("pivot").distinct().collect()]
        if not needed:
            return spark.createDataFrame([], out)
        vectors = index.vectors().where(F.col("pivot").isin(needed))
        vectors = vectors if where is None else vectors.where(where)
        vectors = vectors.select("pivot", "part", "item_id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))).alias("deal"))
        parts = index.vectors().where(F.col("pivot").isin(needed)).select("pivot", "part").distinct()
        sent = wanted.select("query_id", "q", "pivot", deal).join(parts, "pivot")
        key = ["pivot", "part", "deal"]
        return vectors.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(best_products(k, threshold), out)

    best = found(asked.mapInArrow(first(k), pairs))
    ranked = top(best, k, F.desc("score"), F.asc("item_id"))
    floor = ranked.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
    open_ = asked.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float(threshold))))
    more = found(open_.mapInArrow(rest(k), pairs))
    hits = top(ranked.select("query_id", "item_id", "score").unionAll(more), k, F.desc("score"), F.asc("item_id"))
    return hits.select("query_id", "item_id", jround("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))
