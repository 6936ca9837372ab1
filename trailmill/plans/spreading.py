"""Rows dealt over the cluster's cores before work that costs far more than the reading.

A compact table of many rows has few splits, and its rows would then be worked on by as few tasks. The number of parts is stated,
since adaptive execution joins parts that are small in bytes, whatever their rows cost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

_PER_CORE = 4


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(_PER_CORE * max(2, rows.sparkSession.sparkContext.defaultParallelism), *keys)
