"""Run-state queries over the event table: run = user."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmill.catalog import query
from trailmill.operators import state as S
from trailmill.sources.tables import table

_NAMES = {"signup": "QUEUED", "view": "RUNNING", "click": "RUNNING", "error": "FAILED", "purchase": "COMPLETED"}
_STATUS = "CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'view' THEN 'RUNNING' WHEN 'click' THEN 'RUNNING' WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'COMPLETED' END"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("ts").alias("at"), "event_id", F.col("event_type").alias("type"), "value", "props")


@query(
    "run_state_fold",
    f"WITH e AS (SELECT user_id AS run_id, ts, event_id, {_STATUS} AS s FROM events), g AS (SELECT run_id, min((ts, event_id, s)) FILTER (s IN ('COMPLETED', 'FAILED')) AS fin, max((ts, event_id, s)) AS lst, count(*) AS n FROM e GROUP BY 1) SELECT run_id, coalesce(fin[3], lst[3]) AS status, coalesce(fin[1], lst[1]) AS since, n FROM g",
)
def run_state_fold(spark, sf_dir):
    return S.folded(_events(spark, sf_dir), _NAMES)


@query("bounded_event_log", "SELECT user_id AS run_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS age FROM events QUALIFY age <= 20")
def bounded_event_log(spark, sf_dir):
    return S.bounded_log(_events(spark, sf_dir), 20).select("run_id", "event_id", "age")


@query(
    "idempotent_requests",
    "WITH f AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_id, arg_min(event_type, (ts, event_id)) AS first_type FROM events GROUP BY 1) SELECT e.user_id AS run_id, event_id, CASE WHEN event_id = first_id THEN 'created' WHEN event_type = first_type THEN 'replayed' ELSE 'conflict' END AS outcome FROM events e JOIN f ON e.user_id = f.user_id",
)
def idempotent_requests(spark, sf_dir):
    return S.idempotent(_events(spark, sf_dir).withColumn("request", F.col("type"))).select("run_id", "event_id", "outcome")


@query(
    "daily_budget",
    "WITH e AS (SELECT event_id, ts, CAST(floor(value * 100) AS BIGINT) AS cents FROM events) SELECT event_id, CAST(sum(cents) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent_cents, spent_cents <= 50000 AS allowed FROM e",
)
def daily_budget(spark, sf_dir):
    return S.daily_budget(_events(spark, sf_dir).withColumn("cents", F.floor(F.col("value") * 100)), 50000).select("event_id", "spent_cents", "allowed")


@query(
    "circuit_breaker",
    "WITH e AS (SELECT user_id % 50 AS agent, ts, event_id, event_type NOT IN ('error', 'view') AS ok FROM events), g AS (SELECT *, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY agent ORDER BY ts, event_id) AS g FROM e) SELECT agent, event_id, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY agent, g ORDER BY ts, event_id) AS BIGINT) AS failures, failures >= 3 AS open FROM g",
)
def circuit_breaker(spark, sf_dir):
    calls = _events(spark, sf_dir).select((F.col("run_id") % 50).alias("agent"), "at", "event_id", (~F.col("type").isin("error", "view")).alias("ok"))
    return S.breaker(calls, 3).select("agent", "event_id", "failures", "open")


@query(
    "stream_outcome",
    "WITH g AS (SELECT user_id AS run_id, min((ts, event_id)) FILTER (event_type = 'purchase') AS d, min((ts, event_id)) FILTER (event_type = 'error') AS e FROM events GROUP BY 1) SELECT run_id, CASE WHEN e IS NOT NULL AND (d IS NULL OR e < d) THEN 'error' WHEN d IS NOT NULL THEN 'complete' ELSE 'missing' END AS outcome FROM g",
)
def stream_outcome(spark, sf_dir):
    return S.first_complete(_events(spark, sf_dir), "purchase", "error")


@query("events_json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def events_json_props(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("event_time_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2")
def event_time_windows(spark, sf_dir):
    """A Spark-native extra: tumbling windows, the batch twin of ``streaming.runs.windowed``."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100)).alias("cents")).select(F.col("w.start").alias("start"), "event_type", "n", "cents")


@query(
    "last_assistant_message",
    "SELECT conv_id, arg_max(text, turn) FILTER (role = 'assistant') AS answer, arg_min(text, turn) FILTER (role = 'user') AS question FROM conversations GROUP BY 1",
)
def last_assistant_message(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("answer"), F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("question"))
