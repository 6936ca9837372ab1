"""Run state over a stream of events.

``folded`` keeps, per run, the first terminal event and the latest event, which is all that the batch fold
``operators.state.folded`` needs: so late and repeated deliveries in any order give the batch result. ``windowed``
counts in tumbling event-time windows, with a watermark where late rows are to be dropped. Sinks go through
``foreachBatch``: the newest batch of a key replaces the older ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trailmill.operators.state import STATUS_OF, TERMINAL
from trailmill.plans.shared_store import Store

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, schema: str = EVENTS, pattern: str = "events*.parquet", files_per_batch: int = 100) -> DataFrame:
    """The event files of a folder as a stream, in blocks of files."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _fold(names: dict[str, str]) -> Callable:
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        end_at, end_id, end_s, last_at, last_id, last_s, n = state.get if state.exists else (None, None, None, None, None, None, 0)
        for frame in frames:
            for at, event, kind in zip(frame["at"], frame["event_id"], frame["type"], strict=True):
                status = names.get(kind)
                if status is None:
                    continue
                n += 1
                place = (at.to_pydatetime(), int(event))
                if status in TERMINAL and (end_s is None or place < (end_at, end_id)):
                    end_at, end_id, end_s = (*place, status)
                if last_s is None or place > (last_at, last_id):
                    last_at, last_id, last_s = (*place, status)
        if n:
            state.update((end_at, end_id, end_s, last_at, last_id, last_s, n))
            yield pd.DataFrame({"run_id": [key[0]], "status": [end_s or last_s], "since": [end_at if end_s else last_at], "n": [n]})

    return step


def folded(stream: DataFrame, names: dict[str, str] = STATUS_OF) -> DataFrame:
    """(run_id, status, since, n) of every run that a batch touches. stream: run_id, at, event_id, type."""
    return stream.groupBy("run_id").applyInPandasWithState(
        _fold(names), "run_id long, status string, since timestamp, n long", "end_at timestamp, end_id long, end_s string, last_at timestamp, last_id long, last_s string, n long", "update", GroupStateTimeout.NoTimeout
    )


def windowed(stream: DataFrame, length: str = "1 hour", lateness: str | None = None) -> DataFrame:
    """(start, event_type, n, cents) by tumbling window of ``ts``; rows later than ``lateness`` are dropped, none if it is not given."""
    seen = stream.withWatermark("ts", lateness) if lateness else stream
    out = seen.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100)).alias("cents"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "cents")


def deduplicated(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Each event id once within the watermark."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def drained(stream: DataFrame, store: Store, keys: list[str], mode: str = "update") -> DataFrame:
    """Runs the stream over all that is there now and returns the newest row per key, as a batch frame."""
    spark, target = stream.sparkSession, f"{store.root}/stream"
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{store.root}/progress").trigger(availableNow=True).foreachBatch(write).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    if query.exception():
        raise query.exception()
    if not query.recentProgress:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema.add("_batch", "long")).parquet(f"{target}/batch=*")
    rest = [c for c in schema.names if c not in keys and c != "_batch"]
    newest = rows.groupBy(*keys).agg(F.max(F.struct("_batch", *rest)).alias("r"))
    return newest.select(*keys, *[F.col("r")[c].alias(c) for c in rest])
