"""Dataset packages: several tables of text lines that become one thing by a manifest.

The tables are written first, in files of bounded length, and the manifest last. It lists every file with its size and SHA-256, and its
first line holds the facts and the digest of the list. A package without a whole manifest does not exist for readers, and one
whose files differ from the manifest (changed, missing, too many) is refused.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.plans.shared_store import exists
from trailmill.sources.vector_index import digest

VERSION = 1
_FILES = "name string, file string, bytes long, sha256 string"


class BrokenPackage(ValueError):
    """A package that is not whole or not what its manifest says."""


def _files(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """Every file of the tables as it lies there. A file is hashed whole in one task; the writer bounds its length."""
    out = spark.createDataFrame([], _FILES)
    for name in names:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/{name}")
        out = out.unionAll(found.select(F.lit(name).alias("name"), F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")))
    return out


def _listed(files: DataFrame) -> str:
    return digest(files.select(F.concat_ws("|", "name", "file", "bytes", "sha256")))


def write_package(tables: Mapping[str, DataFrame], folder: str, facts: Mapping[str, Any], lines_a_file: int = 100_000) -> None:
    """tables: lines (``value``) by name. facts: what else the manifest says. An existing package is never written over."""
    spark = next(iter(tables.values())).sparkSession
    if exists(spark, f"{folder}/manifest/_SUCCESS"):
        raise FileExistsError(f"{folder} holds a package")
    for name, lines in tables.items():
        lines.select("value").write.mode("overwrite").option("maxRecordsPerFile", lines_a_file).text(f"{folder}/{name}")
    files = _files(spark, folder, list(tables))
    head = {"version": VERSION, "tables": list(tables), "facts": dict(facts), "files_sha256": _listed(files)}
    top = spark.createDataFrame([(json.dumps(head, sort_keys=True),)], "value string")
    top.unionAll(files.select(F.to_json(F.struct(*files.columns)))).write.mode("overwrite").text(f"{folder}/manifest")


def read_package(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict[str, Any]]:
    """The tables and the facts, after every file has been held against the manifest."""
    if not exists(spark, f"{folder}/manifest/_SUCCESS"):
        raise BrokenPackage(f"{folder} has no whole manifest")
    lines = spark.read.text(f"{folder}/manifest")
    heads = lines.where(F.get_json_object("value", "$.version").isNotNull()).limit(2).collect()
    if len(heads) != 1 or (head := json.loads(heads[0]["value"]))["version"] != VERSION:
        raise BrokenPackage(f"{folder}: the manifest has no head of version {VERSION}")
    listed = lines.where(F.get_json_object("value", "$.version").isNull()).select(F.from_json("value", _FILES).alias("f")).select("f.*")
    if _listed(listed) != head["files_sha256"]:
        raise BrokenPackage(f"{folder}: the list of files is not the one the manifest was made with")
    if gone := [name for name in head["tables"] if not exists(spark, f"{folder}/{name}")]:
        raise BrokenPackage(f"{folder}: no table {gone[0]}")
    there = _files(spark, folder, head["tables"])
    odd = listed.exceptAll(there).select("name", "file").unionAll(there.exceptAll(listed).select("name", "file")).limit(3).collect()
    if odd:
        raise BrokenPackage(f"{folder}: {', '.join(sorted({f'{r[0]}/{r[1]}' for r in odd}))} not as in the manifest")
    return {name: spark.read.text(f"{folder}/{name}", wholetext=False) for name in head["tables"]}, head["facts"]
