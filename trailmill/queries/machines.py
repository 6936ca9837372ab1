"""State machines over the event table, delivered in three batches with late and repeated rows and a restart between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmill.catalog import query
from trailmill.plans.shared_store import Store
from trailmill.sources.tables import table
from trailmill.streaming import machines as M

_BATCHES = 3


def _delivered(spark, sf_dir):
    """Events with the batch that brings them: ten days each; every 11th comes one batch late, every 13th a second time."""
    e = table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "user_id", "event_type")
    own = F.least(F.lit(_BATCHES), 1 + F.floor((F.floor(F.col("at") / 86_400_000_000) - 19723) / 10))
    e = e.withColumn("batch", F.least(F.lit(_BATCHES), own + F.when(F.col("event_id") % 11 == 0, 1).otherwise(0)).cast("int"))
    again = e.where((F.col("event_id") % 13 == 0) & (F.col("batch") < _BATCHES)).withColumn("batch", F.col("batch") + 1)
    return e.unionAll(again)


def _fold_sql(key: str, columns: dict[str, str], interrupts: bool, first: str, step: str, out: str) -> str:
    """first: the state before any row; step: the state and outputs after row ``e`` from state ``f``; out: what is told."""
    restart = f"UNION ALL SELECT k, x.b, NULL, NULL, {', '.join('NULL' for _ in columns)} FROM (SELECT k, min(b) AS b FROM kept GROUP BY k) o JOIN (SELECT unnest([2, 3]) AS b) x ON o.b < x.b" if interrupts else ""
    held = ", ".join(f"{v} AS {k}" for k, v in columns.items())
    return f"""WITH RECURSIVE own AS (SELECT *, epoch_us(ts) AS t, least(3, 1 + CAST(floor((floor(epoch_us(ts) / 86400000000) - 19723) / 10) AS BIGINT)) AS b0 FROM events),
one AS (SELECT *, least(3, b0 + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END) AS b1 FROM own),
delivered AS (SELECT *, b1 AS b FROM one UNION ALL SELECT *, b1 + 1 FROM one WHERE event_id % 13 = 0 AND b1 < 3),
placed AS (SELECT {key} AS k, b, t, event_id, {held}, max((t, event_id)) OVER (PARTITION BY {key} ORDER BY b RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM delivered),
kept AS (SELECT DISTINCT k, b, t, event_id, {', '.join(columns)} FROM placed WHERE before IS NULL OR (t, event_id) > before {restart}),
seq AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY b, event_id IS NOT NULL, t, event_id) AS n FROM kept),
f AS (SELECT DISTINCT k, 0 AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS t, {first} FROM seq
  UNION ALL SELECT e.k, e.n, e.event_id, coalesce(e.t, f.t) AS t, {step} FROM f JOIN seq e ON e.k = f.k AND e.n = f.n + 1)
SELECT k AS key, t AS "at", event_id, {out}"""


_RUN_COMMAND = "CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'start' WHEN 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'resume' ELSE 'progress' END WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'fail' ELSE 'cancel' END ELSE 'complete' END"
_RUN_STATUS = """CASE WHEN e.command IS NULL THEN CASE WHEN f.status IN ('QUEUED', 'RUNNING') THEN 'RECOVERY_REQUIRED' ELSE f.status END
    WHEN e.command = 'create' THEN coalesce(f.status, 'QUEUED') WHEN f.status IS NULL THEN NULL WHEN e.command = 'start' AND f.status = 'QUEUED' THEN 'RUNNING'
    WHEN e.command = 'complete' AND f.status = 'RUNNING' THEN 'COMPLETED' WHEN e.command = 'fail' AND f.status NOT IN ('COMPLETED', 'FAILED', 'CANCELLED') THEN 'FAILED'
    WHEN e.command = 'cancel' AND f.status NOT IN ('COMPLETED', 'FAILED', 'CANCELLED') THEN 'CANCELLED' WHEN e.command = 'resume' AND f.status IN ('FAILED', 'CANCELLED', 'RECOVERY_REQUIRED') THEN 'QUEUED' ELSE f.status END"""
_RUN_OUTCOME = """CASE WHEN e.command IS NULL THEN CASE WHEN f.status IN ('QUEUED', 'RUNNING') THEN 'applied' END
    WHEN e.command = 'create' THEN CASE WHEN f.status IS NULL THEN 'applied' ELSE 'ignored' END WHEN f.status IS NULL THEN 'rejected'
    WHEN e.command = 'progress' THEN CASE WHEN f.status = 'RUNNING' THEN 'applied' ELSE 'ignored' END WHEN e.command = 'start' THEN CASE WHEN f.status = 'QUEUED' THEN 'applied' ELSE 'rejected' END
    WHEN e.command = 'complete' THEN CASE f.status WHEN 'RUNNING' THEN 'applied' WHEN 'COMPLETED' THEN 'ignored' ELSE 'rejected' END
    WHEN e.command IN ('fail', 'cancel') THEN CASE WHEN f.status IN ('COMPLETED', 'FAILED', 'CANCELLED') THEN 'ignored' ELSE 'applied' END
    ELSE CASE WHEN f.status IN ('FAILED', 'CANCELLED', 'RECOVERY_REQUIRED') THEN 'applied' ELSE 'rejected' END END"""


@query(
    "run_machine",
    _fold_sql(
        "user_id", {"command": _RUN_COMMAND}, True, "CAST(NULL AS VARCHAR) AS command, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS VARCHAR) AS status, 0 AS attempt",
        f"coalesce(e.command, 'interrupted'), {_RUN_OUTCOME}, {_RUN_STATUS}, CASE WHEN e.command = 'create' AND f.status IS NULL THEN 1 WHEN e.command = 'resume' AND f.status IN ('FAILED', 'CANCELLED', 'RECOVERY_REQUIRED') THEN f.attempt + 1 ELSE f.attempt END",
        "command, outcome, status, CAST(attempt AS INTEGER) AS attempt FROM f WHERE outcome IS NOT NULL",
    ),
)
def run_machine(spark, sf_dir):
    rows = _delivered(spark, sf_dir).select(F.col("user_id").alias("key"), "at", "event_id", F.expr(_RUN_COMMAND).alias("command"), "batch")
    return M.replayed(rows, M.Runs(), Store(spark, "run-machine"), _BATCHES, "status IN ('QUEUED', 'RUNNING')")


_COOLDOWN = 21_600_000_000
_HALF = f"(f.open_until IS NOT NULL AND e.t >= f.open_until)"
_CLOSED = f"(f.open_until IS NULL OR e.t >= f.open_until)"
_FAILURES = f"CASE WHEN NOT {_CLOSED} THEN f.failures WHEN e.ok THEN 0 WHEN {_HALF} THEN 3 ELSE f.failures + 1 END"


@query(
    "breaker_machine",
    _fold_sql(
        "user_id % 50", {"ok": "event_type NOT IN ('error', 'view')"}, False, "CAST(NULL AS BOOLEAN) AS allowed, 0 AS failures, CAST(NULL AS BIGINT) AS open_until",
        f"{_CLOSED}, {_FAILURES}, CASE WHEN NOT {_CLOSED} THEN f.open_until WHEN {_FAILURES} >= 3 THEN e.t + {_COOLDOWN} END",
        "allowed, CAST(failures AS INTEGER) AS failures, CASE WHEN open_until IS NULL THEN 'closed' ELSE 'open' END AS state FROM f WHERE n > 0",
    ),
)
def breaker_machine(spark, sf_dir):
    rows = _delivered(spark, sf_dir).select((F.col("user_id") % 50).alias("key"), "at", "event_id", (~F.col("event_type").isin("error", "view")).alias("ok"), "batch")
    return M.replayed(rows, M.Breaker(3, _COOLDOWN), Store(spark, "breaker-machine"), _BATCHES)


_BUDGET = {
    "command": "CASE WHEN event_type IN ('signup', 'view') THEN 'run' WHEN event_type = 'click' THEN 'finish' WHEN event_type = 'error' THEN CASE WHEN event_id % 4 = 0 THEN 'break' ELSE 'finish' END WHEN event_id % 10 = 0 THEN 'pause' WHEN event_id % 10 < 4 THEN 'resume' ELSE 'finish' END",
    "requested": "event_id % 40",
    "pending": "event_id % 50",
    "assessed": "event_id % 30",
    "incomplete": "CASE WHEN event_id % 3 = 0 THEN event_id % 30 ELSE 0 END",
}
_LIMIT, _COOL = 45, 43_200_000_000
_SPENT = "CASE WHEN e.event_id IS NULL OR e.t // 86400000000 = f.day THEN f.spent ELSE 0 END"
_OUTCOME = f"""CASE WHEN e.event_id IS NULL THEN CASE WHEN f.running THEN 'recovered' END
    WHEN e.command = 'run' THEN CASE WHEN f.running THEN 'busy' WHEN f.paused THEN 'paused' WHEN f.cool_until IS NOT NULL AND e.t < f.cool_until THEN 'cooldown' WHEN {_SPENT} >= {_LIMIT} THEN 'daily_limit'
      WHEN least(e.requested, {_LIMIT} - {_SPENT}, e.pending) <= 0 THEN 'idle' ELSE 'started' END
    WHEN e.command IN ('finish', 'break') AND NOT f.running THEN 'ignored' ELSE 'applied' END"""
_FAILED = "(f.running AND (e.command = 'break' OR e.command = 'finish' AND e.assessed > 0 AND e.incomplete = e.assessed))"
_DONE = f"(f.running AND e.command = 'finish' AND NOT {_FAILED})"
_COUNT = f"CASE WHEN e.event_id IS NULL THEN f.failures + CASE WHEN f.running THEN 1 ELSE 0 END WHEN e.command = 'resume' OR {_DONE} THEN 0 WHEN {_FAILED} THEN f.failures + 1 ELSE f.failures END"


@query(
    "budget_machine",
    _fold_sql(
        "user_id % 20", _BUDGET, True,
        "CAST(NULL AS VARCHAR) AS command, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS BIGINT) AS granted, CAST(0 AS BIGINT) AS spent, CAST(0 AS BIGINT) AS failures, false AS paused, false AS running, CAST(NULL AS BIGINT) AS day, CAST(NULL AS BIGINT) AS cool_until",
        f"""coalesce(e.command, 'interrupted'), {_OUTCOME}, CASE WHEN e.command = 'run' THEN CASE WHEN ({_OUTCOME}) = 'started' THEN least(e.requested, {_LIMIT} - {_SPENT}, e.pending) ELSE 0 END END,
    {_SPENT} + CASE WHEN f.running AND e.command = 'finish' THEN e.assessed ELSE 0 END, {_COUNT},
    CASE WHEN e.command = 'pause' THEN true WHEN e.command = 'resume' THEN false ELSE f.paused END,
    CASE WHEN e.event_id IS NULL OR e.command <> 'run' THEN false ELSE f.running OR ({_OUTCOME}) = 'started' END,
    CASE WHEN e.event_id IS NULL THEN f.day ELSE e.t // 86400000000 END,
    CASE WHEN e.event_id IS NULL THEN f.cool_until WHEN e.command = 'resume' OR {_DONE} THEN NULL WHEN {_FAILED} THEN CASE WHEN ({_COUNT}) >= 2 THEN e.t + {_COOL} END ELSE f.cool_until END""",
        "command, outcome, granted, CAST(spent AS BIGINT) AS spent, CAST(failures AS INTEGER) AS failures FROM f WHERE outcome IS NOT NULL",
    ),
)
def budget_machine(spark, sf_dir):
    e = _delivered(spark, sf_dir)
    rows = e.select((F.col("user_id") % 20).alias("key"), "at", "event_id", *[F.expr(v).alias(k) for k, v in _BUDGET.items()], "batch")
    return M.replayed(rows, M.Budget(_LIMIT, 2, _COOL), Store(spark, "budget-machine"), _BATCHES, "running")
