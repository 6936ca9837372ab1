"""Run state from events: folds, bounded logs, idempotent creation, budgets, breakers. Batch forms of ``streaming``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("COMPLETED", "FAILED", "CANCELLED")
#: event type -> status it leads to; an attempt is counted by each start.
STATUS_OF = {"queued": "QUEUED", "started": "RUNNING", "completed": "COMPLETED", "failed": "FAILED", "cancelled": "CANCELLED"}


def folded(events: DataFrame, names: dict[str, str] = STATUS_OF) -> DataFrame:
    """Final state per run: terminal states absorb, so the first terminal event in order decides; otherwise the last event does.

    events: run_id, at, event_id, type. One aggregate with partial results: no run's events meet in one row.
    """
    status = None
    for k, v in names.items():
        status = F.when(F.col("type") == k, v) if status is None else status.when(F.col("type") == k, v)
    order = F.struct("at", "event_id", status.alias("s"))
    g = events.where(status.isNotNull()).groupBy("run_id").agg(F.min(F.when(status.isin(*TERMINAL), order)).alias("end"), F.max(order).alias("last"), F.count("*").alias("n"))
    return g.select("run_id", F.coalesce("end.s", "last.s").alias("status"), F.coalesce("end.at", "last.at").alias("since"), "n")


def bounded_log(events: DataFrame, n: int = 200) -> DataFrame:
    """The newest ``n`` events per run, numbered from the newest."""
    w = Window.partitionBy("run_id").orderBy(F.desc("at"), F.desc("event_id"))
    return events.withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)


def idempotent(requests: DataFrame) -> DataFrame:
    """Adds ``outcome``: created for an id's first request, replayed for the same request again, conflict for another one."""
    first = requests.groupBy("run_id").agg(F.min(F.struct("at", "event_id", "request")).alias("f"))
    out = requests.join(first, "run_id")
    return out.withColumn("outcome", F.when(F.col("event_id") == F.col("f.event_id"), "created").when(F.col("request").eqNullSafe(F.col("f.request")), "replayed").otherwise("conflict")).drop("f")


def daily_budget(events: DataFrame, limit: float) -> DataFrame:
    """Running cost per day and whether an event is still within the day's budget. Within a day in order of time and id."""
    w = Window.partitionBy(F.to_date("at")).orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("spent_cents", F.sum("cents").over(w)).withColumn("allowed", F.col("spent_cents") <= limit)


def breaker(calls: DataFrame, threshold: int) -> DataFrame:
    """Consecutive failures per agent, and whether the breaker is open after each call."""
    w = Window.partitionBy("agent").orderBy("at", "event_id")
    island = calls.withColumn("_g", F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(w))
    run = F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(Window.partitionBy("agent", "_g").orderBy("at", "event_id"))
    return island.withColumn("failures", run).withColumn("open", F.col("failures") >= threshold).drop("_g")


def first_complete(events: DataFrame, done: str, error: str) -> DataFrame:
    """Outcome per run of a pushed stream: the first completion, else the error, else missing."""
    g = events.groupBy("run_id").agg(F.min(F.when(F.col("type") == done, F.struct("at", "event_id"))).alias("d"), F.min(F.when(F.col("type") == error, F.struct("at", "event_id"))).alias("e"))
    return g.select("run_id", F.when(F.col("e").isNotNull() & (F.col("d").isNull() | (F.col("e") < F.col("d"))), "error").when(F.col("d").isNotNull(), "complete").otherwise("missing").alias("outcome"))
