"""Intermediate tables in the folder that every executor shares.

A lineage is cut by writing Parquet below the folder that the session names in ``spark.checkpoint.dir``
and reading it back with a known schema. Losing an executor then costs nothing that was already written.
All tables of an application lie in one folder, which goes when the driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_FALLBACK: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The session's shared folder. Only a local session, whose tasks all run on this machine, may do without one."""
    named = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"{_KEY} must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="trailmill-")
    return _FALLBACK[app]


_OWN: set[str] = set()


def application_folder(spark: SparkSession) -> str:
    """A folder of the application's own in the shared one; it goes when the driver ends."""
    folder = f"{shared_root(spark)}/trailmill/{spark.sparkContext.applicationId}"
    if folder not in _OWN:
        _OWN.add(folder)
        atexit.register(_emptied, spark, folder)
    return folder


def _emptied(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        _delete(spark, folder)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _at(spark: SparkSession, path: str):
    """(file system, path)"""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _at(spark, path)
    return files.exists(target)


def removed(spark: SparkSession, path: str) -> None:
    files, target = _at(spark, path)
    files.delete(target, True)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders below one; none if it is not there."""
    files, target = _at(spark, path)
    return [x.getPath().getName() for x in files.listStatus(target) if x.isDirectory()] if files.exists(target) else []


def renamed(spark: SparkSession, path: str, to: str) -> None:
    """Moves a folder; its new parent is made where it is missing."""
    files, target = _at(spark, to)
    files.mkdirs(target.getParent())
    if not files.rename(spark._jvm.org.apache.hadoop.fs.Path(path), target):
        raise OSError(f"{path} could not be moved to {to}")


class Store:
    """Tables of one operator call. ``put`` writes and rereads; ``drop`` removes one that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{application_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._paths: dict[int, str] = {}
        self._n = 0

    def put(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/t{self._n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self._paths.pop(id(df), None)
        if path:
            _delete(self.spark, path)


def small(df: DataFrame, limit: int) -> bool:
    """Whether the frame has at most ``limit`` rows: the check that must stand before any broadcast."""
    return df.limit(limit + 1).count() <= limit
