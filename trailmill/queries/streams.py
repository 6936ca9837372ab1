"""Streams drained over the event table; each has the result of its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmill.catalog import ORACLES, query
from trailmill.plans.shared_store import Store
from trailmill.queries.state import _NAMES
from trailmill.streaming import runs


@query("stream_run_state", ORACLES["run_state_fold"])
def stream_run_state(spark, sf_dir):
    stream = runs.events(spark, sf_dir).select(F.col("user_id").alias("run_id"), F.col("ts").alias("at"), "event_id", F.col("event_type").alias("type"))
    return runs.drained(runs.folded(stream, _NAMES), Store(spark, "run-state"), ["run_id"])


@query("stream_event_windows", ORACLES["event_time_windows"])
def stream_event_windows(spark, sf_dir):
    return runs.drained(runs.windowed(runs.events(spark, sf_dir)), Store(spark, "windows"), ["start", "event_type"])
