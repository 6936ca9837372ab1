"""Recomputation on a schedule: the whole result anew at every tick, put in place of the last at one stroke."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from trailmill.plans.shared_store import exists, removed, subfolders


def versions(spark: SparkSession, target: str) -> list[int]:
    """The whole versions below a folder; one whose write has not ended has no mark of success and is none."""
    found = [x.partition("=")[2] for x in subfolders(spark, target) if x.startswith("version=")]
    return sorted(int(x) for x in found if x.isdigit() and exists(spark, f"{target}/version={x}/_SUCCESS"))


def publish(df: DataFrame, target: str, keep: int = 2) -> int:
    """Writes the next version; readers see the old one until the new one is whole. Versions before the last ``keep`` go, as does what a
    lost driver left half-written."""
    spark = df.sparkSession
    whole = versions(spark, target)
    number = whole[-1] + 1 if whole else 1
    removed(spark, f"{target}/version={number}")
    df.write.option("compression", "zstd").parquet(f"{target}/version={number}")
    for old in whole[: len(whole) + 1 - keep]:
        removed(spark, f"{target}/version={old}")
    return number


def published(spark: SparkSession, target: str) -> DataFrame:
    """The newest whole version."""
    whole = versions(spark, target)
    if not whole:
        raise FileNotFoundError(f"{target} holds no whole version")
    return spark.read.parquet(f"{target}/version={whole[-1]}")


def scheduled(spark: SparkSession, recompute: Callable[[], DataFrame], target: str, progress: str, every: str = "30 seconds", keep: int = 2) -> StreamingQuery:
    """Publishes ``recompute()`` at every tick until the query is stopped. Not incremental on purpose: windows that move with time
    change although no row comes. A tick that is missed while one runs is left out, as with a fixed delay."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.trigger(processingTime=every).option("checkpointLocation", progress).foreachBatch(lambda _, n: publish(recompute(), target, keep) and None).start()
