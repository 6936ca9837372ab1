"""Stateful queries on the newer state interface: the session they need, and feeding them batch by batch on one checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from trailmill.plans.shared_store import Store, exists, renamed

#: RocksDB is what the state interface works on. Changelogs keep commits small, one bound holds the memory of all instances, and
#: a task closes its instance (4 MB of disk at the least) when it ends, since every start opens its state anew.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
_KEPT = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.files.maxPartitionBytes")


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application with the state store set, so that the caller's settings stay."""
    session = spark.newSession()
    for name, value in ({k: spark.conf.get(k) for k in _KEPT} | _STATE).items():
        session.conf.set(name, value)
    return session


class Feed:
    """Numbered batches that reach one streaming query in order. The query is started anew for each on one checkpoint, so that each
    start is a restart: state and offsets come back from the shared folder, and the file sink commits each result once.

    rows must hold the column ``batch``; it is written once, by batch, and a batch is moved into the source's folder when its
    turn comes.
    """

    def __init__(self, rows: DataFrame, store: Store):
        self.spark, self.schema, self.root = rows.sparkSession, rows.schema, store.root
        self.session = stateful_session(self.spark)
        rows.selectExpr("*", "batch AS fed").write.partitionBy("fed").option("compression", "zstd").parquet(f"{self.root}/staged")
        self.progress, self.target = f"{self.root}/progress", f"{self.root}/results"

    def staged(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/staged")

    def batches(self, numbers: range) -> Iterator[int]:
        """The numbers of batches that have rows, each moved into the source's folder."""
        for n in numbers:
            if exists(self.spark, f"{self.root}/staged/fed={n}"):
                renamed(self.spark, f"{self.root}/staged/fed={n}", f"{self.root}/feed/fed={n}")
                yield n

    def add(self, rows: DataFrame, name: str) -> None:
        """More rows for the start to come, such as what a restart has found."""
        rows.select(*self.schema.names).write.parquet(f"{self.root}/feed/{name}")

    def start(self, transform: Callable[[DataFrame], DataFrame]) -> None:
        """One start over all that is new in the source's folder."""
        stream = transform(self.session.readStream.schema(self.schema).parquet(f"{self.root}/feed/*"))
        self.out = stream.schema
        run = stream.writeStream.format("parquet").outputMode("append").option("path", self.target).option("checkpointLocation", self.progress).trigger(availableNow=True).start()
        try:
            run.awaitTermination()
        finally:
            run.stop()

    def state(self, name: str) -> DataFrame:
        """A state variable of the query as a table: ``key`` and ``value``."""
        return self.session.read.format("statestore").option("stateVarName", name).load(self.progress)

    def results(self) -> DataFrame:
        return self.spark.read.schema(self.out).parquet(self.target)
