"""State machines: literal cases, timers that fire without rows, restarts, scheduled recomputation."""

import time

import pytest
from pyspark.sql import functions as F

from trailmill.plans.shared_store import Store, shared_root
from trailmill.streaming import machines as M
from trailmill.streaming import scheduled as P
from trailmill.streaming.stateful import stateful_session


def walk(machine, rows):
    """What a machine gives for one key's rows, without Spark."""
    s, out = machine.first() | {"last_at": None, "last_id": None}, []
    for n, row in enumerate(rows):
        if row.get("command") != M.INTERRUPTED:
            s["last_at"], s["last_id"] = row.get("at", n), n
        out.append(machine.step(s, {"event_id": None if row.get("command") == M.INTERRUPTED else n, **row}))
    return out, s


def statuses(*commands):
    return [x and (x[1], x[2], x[3]) for x in walk(M.Runs(), [{"command": c} for c in commands])[0]]


def test_run_completes_and_absorbs():
    assert statuses("start", "create", "create", "progress", "start", "start", "progress", "complete", "complete", "fail", "cancel", "resume") == [
        ("rejected", None, 0), ("applied", "QUEUED", 1), ("ignored", "QUEUED", 1), ("ignored", "QUEUED", 1), ("applied", "RUNNING", 1), ("rejected", "RUNNING", 1), ("applied", "RUNNING", 1),
        ("applied", "COMPLETED", 1), ("ignored", "COMPLETED", 1), ("ignored", "COMPLETED", 1), ("ignored", "COMPLETED", 1), ("rejected", "COMPLETED", 1),
    ]


@pytest.mark.parametrize("end", ["fail", "cancel", M.INTERRUPTED])
def test_run_resumes_as_a_new_attempt(end):
    got = statuses("create", "start", end, "complete", "resume", "start")
    assert got[4:] == [("applied", "QUEUED", 2), ("applied", "RUNNING", 2)]
    assert got[3][0] == "rejected" and got[3][1] == {"fail": "FAILED", "cancel": "CANCELLED"}.get(end, "RECOVERY_REQUIRED")


def test_interruption_touches_only_runs_under_way():
    assert statuses("create", "start", "complete", M.INTERRUPTED)[-1] is None
    assert statuses("create", M.INTERRUPTED, "cancel")[1:] == [("applied", "RECOVERY_REQUIRED", 1), ("applied", "CANCELLED", 1)]


def test_breaker_opens_half_opens_and_closes():
    calls = [{"at": t, "ok": ok} for t, ok in [(0, False), (1, False), (2, False), (5, True), (11, True), (12, False), (22, False), (23, False), (24, True), (40, False), (51, True), (52, False)]]
    got, _ = walk(M.Breaker(3, 10), calls)
    # Opened at 2 until 12: refused at 5 and 11. Half-open at 12, so one failure opens it until 22, and so on.
    assert got[:5] == [(True, 1, "closed"), (True, 2, "closed"), (True, 3, "open"), (False, 3, "open"), (False, 3, "open")]
    assert got[5:9] == [(True, 3, "open"), (True, 3, "open"), (False, 3, "open"), (False, 3, "open")]
    assert got[9:] == [(True, 3, "open"), (True, 0, "closed"), (True, 1, "closed")]


def test_budget_grants_what_is_left_and_cools_down():
    day = M._DAY
    run = lambda at, requested=9, pending=99: {"at": at, "command": "run", "requested": requested, "pending": pending}
    done = lambda at, assessed, incomplete=0: {"at": at, "command": "finish", "assessed": assessed, "incomplete": incomplete}
    got, _ = walk(M.Budget(10, 2, 100), [run(0), run(1), done(2, 9), run(3), done(4, 1), run(5), run(day), done(day + 1, 3, 3), run(day + 2), {"at": day + 3, "command": "break"}, run(day + 50), run(day + 103, pending=0), run(day + 104)])
    assert [(x[1], x[2]) for x in got] == [("started", 9), ("busy", 0), ("applied", None), ("started", 1), ("applied", None), ("daily_limit", 0), ("started", 9), ("applied", None), ("started", 7), ("applied", None), ("cooldown", 0), ("idle", 0), ("started", 7)]
    assert [x[4] for x in got[6:10]] == [0, 1, 1, 2]


def test_budget_pause_resume_and_interruption():
    got, s = walk(M.Budget(10, 1, 100), [{"command": "pause"}, {"command": "run", "requested": 1, "pending": 1}, {"command": "resume"}, {"command": "run", "requested": 1, "pending": 1}, {"command": M.INTERRUPTED}, {"command": M.INTERRUPTED}, {"command": "finish", "assessed": 1}])
    assert [x and x[1] for x in got] == ["applied", "paused", "applied", "started", "recovered", None, "ignored"]
    assert s["failures"] == 1 and not s["running"]


def test_timers_fire_without_rows(spark, tmp_path):
    """A breaker half-opens and a silent run is given up although nothing more comes."""
    now = int(time.time() * 1e6)
    for name, rows, schema, machine in (
        ("breaker", [(1, now, 1, False), (1, now, 2, False), (2, now, 3, True)], "key long, at long, event_id long, ok boolean", M.Breaker(2, 1_000_000, live=True)),
        ("run", [(1, now, 1, "create"), (1, now, 2, "start"), (2, now, 3, "create")], "key long, at long, event_id long, command string", M.Runs(live=True, lease=1_000_000)),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name / "in"))
        stream = stateful_session(spark).readStream.schema(schema).parquet(str(tmp_path / name / "in"))
        out, target = M.machine(stream, machine), str(tmp_path / name / "out")
        query = out.writeStream.format("parquet").option("path", target).option("checkpointLocation", str(tmp_path / name / "progress")).trigger(processingTime="500 milliseconds").start()
        try:
            deadline = time.time() + 90
            while time.time() < deadline:
                time.sleep(1)
                if query.exception():
                    raise query.exception()
                if query.lastProgress and spark.read.schema(out.schema).parquet(target).where("event_id IS NULL").count():
                    break
        finally:
            query.stop()
        late = spark.read.schema(out.schema).parquet(target).where("event_id IS NULL").collect()
        assert [(r["key"], r["failures"], r["state"]) if name == "breaker" else (r["key"], r["command"], r["status"]) for r in late] == [(1, 1, "half_open") if name == "breaker" else (1, "lease", "RECOVERY_REQUIRED")]
        assert all(r["at"] >= now + 1_000_000 for r in late)


def test_replay_of_nothing(spark):
    rows = spark.createDataFrame([], "key long, at long, event_id long, command string, batch int")
    assert M.replayed(rows, M.Runs(), Store(spark, "t"), 3, "status = 'RUNNING'").count() == 0


def test_late_and_repeated_rows_change_nothing(spark):
    rows = [(7, 10, 1, "create", 1), (7, 20, 2, "start", 1), (7, 20, 2, "start", 2), (7, 5, 9, "cancel", 2), (7, 30, 3, "resume", 2)]
    df = spark.createDataFrame(rows, "key long, at long, event_id long, command string, batch int")
    got = M.replayed(df, M.Runs(), Store(spark, "t"), 2, "status IN ('QUEUED', 'RUNNING')").orderBy("at", F.col("event_id").isNotNull().desc()).collect()
    assert [(r["at"], r["command"], r["status"], r["attempt"]) for r in got] == [(10, "create", "QUEUED", 1), (20, "start", "RUNNING", 1), (20, "interrupted", "RECOVERY_REQUIRED", 1), (30, "resume", "QUEUED", 2)]


def test_scheduled_results_swap_whole(spark):
    target, ticks = f"{shared_root(spark)}/published", []

    def recompute():
        ticks.append(1)
        return spark.range(len(ticks)).toDF("n")

    with pytest.raises(FileNotFoundError):
        P.published(spark, target)
    query = P.scheduled(spark, recompute, target, f"{shared_root(spark)}/published-progress", every="1 second")
    try:
        deadline = time.time() + 60
        while len(P.versions(spark, target)) < 2 or P.versions(spark, target)[-1] < 3:
            assert time.time() < deadline and not query.exception()
            time.sleep(0.3)
    finally:
        query.stop()
    last = P.versions(spark, target)[-1]
    assert len(P.versions(spark, target)) <= 2 and P.published(spark, target).count() == last
    # A version whose write was cut short is not read, and the next one takes its place.
    spark.range(99).write.parquet(f"{target}/version={last + 1}")
    (mark := spark._jvm.org.apache.hadoop.fs.Path(f"{target}/version={last + 1}/_SUCCESS")).getFileSystem(spark._jsc.hadoopConfiguration()).delete(mark, False)
    assert P.published(spark, target).count() == last
    assert P.publish(spark.range(5), target) == last + 1 and P.published(spark, target).count() == 5


def test_a_key_costs_little():
    """Most keys have few rows, so what is done once a key must not outweigh them."""
    import time

    import pandas as pd

    from trailmill.streaming import machines as M

    class Held:
        def exists(self):
            return False

        def update(self, value):
            pass

    one = M.Runs()
    one.value, one.names = Held(), ["status", "attempt", "seen", "last_at", "last_id", "timer"]
    frame = pd.DataFrame({"key": [1, 1, 1], "at": [5, 6, 7], "event_id": [1.0, None, 3.0], "command": ["create", "interrupted", None], "batch": [1, 1, 1]})
    out = pd.concat(one.handleInputRows((1,), iter([frame]), None))
    assert out.values.tolist() == [[1, 5, 1, "create", "applied", "QUEUED", 1], [1, 7, 3, None, "rejected", "QUEUED", 1]]
    began = time.process_time()
    for _ in range(300):
        list(one.handleInputRows((1,), iter([frame]), None))
    assert (time.process_time() - began) / 300 < 0.002
