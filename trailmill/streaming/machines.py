"""State machines over commands and calls: durable runs, budgeted batches, circuit breakers.

Each is a ``transformWithStateInPandas`` processor with one small value per key. Rows of a key are taken in the order of time
and id; a row at or before the key's last place (late or delivered again) changes nothing and gives nothing. Two ways to run them:

- live (``live=True``): a change that only time brings (a breaker half-opens, a run's lease ends, a day's budget comes back) is
  announced by a processing-time timer, even if no row of the key comes any more;
- replayed: rows carry their own time, and such a change is seen by the next row of its key, so results depend on the rows alone.

After a restart, runs and batches that were under way cannot go on: ``interrupted`` reads the state store as a table and
gives the commands that tell the machines so, without a list of keys on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trailmill.plans.shared_store import Store
from trailmill.streaming.stateful import Feed

#: The command of a restart: it has no id, comes before all others of its start and moves no place.
INTERRUPTED = "interrupted"


def _records(frame: pd.DataFrame) -> list[dict[str, Any]]:
    """Rows as dictionaries of plain values, None for null."""
    columns = []
    for name in frame.columns:
        values = frame[name].tolist()
        # A null makes floats of whole numbers and booleans, and nan is the one value that differs from itself.
        columns.append([None if v is None or v != v else v for v in values])
    return [dict(zip(frame.columns, row, strict=True)) for row in zip(*columns, strict=True)]


class Machine(StatefulProcessor):
    """``fields``: the state's fields beside the last place; ``gives``: what a step gives, after the key, time and id."""

    fields: str
    gives: str

    def first(self) -> dict[str, Any]:
        raise NotImplementedError

    def step(self, s: dict[str, Any], row: dict[str, Any]) -> tuple | None:
        """Changes the state; what it gives, None for nothing."""
        raise NotImplementedError

    def due(self, s: dict[str, Any]) -> int | None:
        """Microseconds since 1970 at which time alone changes the state."""
        return None

    def expired(self, s: dict[str, Any], at: int) -> tuple | None:
        return None

    def __init__(self, live: bool = False):
        self.live = live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("state", f"{self.fields}, last_at long, last_id long, timer long")
        self.names = [f.split()[0] for f in self.fields.split(", ")] + ["last_at", "last_id", "timer"]

    def _load(self) -> dict[str, Any]:
        if self.value.exists():
            return dict(zip(self.names, self.value.get(), strict=True))
        return self.first() | {"last_at": None, "last_id": None, "timer": None}

    def _save(self, s: dict[str, Any]) -> None:
        if self.live:
            due = self.due(s)
            due = None if due is None else due // 1000 + 1
            if due != s["timer"]:
                if s["timer"] is not None:
                    self.handle.deleteTimer(s["timer"])
                if due is not None:
                    self.handle.registerTimer(due)
                s["timer"] = due
        self.value.update(tuple(s[k] for k in self.names))

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        """Of stated types: to find them out costs more than all else that is done for a key. What may be null is an object."""
        names = ["key", "at", "event_id", *(f.split()[0] for f in self.gives.split(", "))]
        return pd.DataFrame(rows, columns=names, dtype=object)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s, out = self._load(), []
        found = [r for frame in rows for r in _records(frame)]
        for r in sorted(found, key=lambda r: (r["event_id"] is not None, r["at"] or 0, r["event_id"] or 0)):
            if r["event_id"] is not None:
                place = (int(r["at"]), int(r["event_id"]))
                if s["last_at"] is not None and place <= (s["last_at"], s["last_id"]):
                    continue
                s["last_at"], s["last_id"] = place
            told = self.step(s, r)
            if told is not None:
                out.append((key[0], s["last_at"], None if r["event_id"] is None else int(r["event_id"]), *told))
        self._save(s)
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self._load()
        at = expiredTimerInfo.getExpiryTimeInMs()
        s["timer"] = None
        told = self.expired(s, at * 1000)
        self._save(s)
        if told is not None:
            yield self._frame([(key[0], at * 1000, None, *told)])

    def close(self) -> None:
        pass


class Runs(Machine):
    """Durable runs. Commands: create, start, progress, complete, fail, cancel, resume. Terminal states absorb; only a failed,
    cancelled or interrupted run can be resumed, as a new attempt. ``lease``: microseconds without a sign of a running run after
    which it counts as interrupted (live only)."""

    fields = "status string, attempt int, seen long"
    gives = "command string, outcome string, status string, attempt int"
    TERMINAL = ("COMPLETED", "FAILED", "CANCELLED")
    RESUMABLE = ("FAILED", "CANCELLED", "RECOVERY_REQUIRED")

    def __init__(self, live: bool = False, lease: int | None = None):
        super().__init__(live)
        self.lease = lease

    def first(self):
        return {"status": None, "attempt": 0, "seen": None}

    def step(self, s, row):
        command, status = row["command"], s["status"]
        s["seen"] = s["last_at"] if row["event_id"] is not None else s["seen"]
        outcome = "applied"
        if command == INTERRUPTED:
            if status not in ("QUEUED", "RUNNING"):
                return None
            s["status"] = "RECOVERY_REQUIRED"
        elif command == "create":
            if status is None:
                s["status"], s["attempt"] = "QUEUED", 1
            else:
                outcome = "ignored"
        elif status is None:
            outcome = "rejected"
        elif command == "start" and status == "QUEUED":
            s["status"] = "RUNNING"
        elif command == "progress":
            outcome = "applied" if status == "RUNNING" else "ignored"
        elif command == "complete" and status in ("RUNNING", "COMPLETED"):
            outcome = "applied" if status == "RUNNING" else "ignored"
            s["status"] = "COMPLETED"
        elif command in ("fail", "cancel"):
            if status in self.TERMINAL:
                outcome = "ignored"
            else:
                s["status"] = "FAILED" if command == "fail" else "CANCELLED"
        elif command == "resume" and status in self.RESUMABLE:
            s["status"], s["attempt"] = "QUEUED", s["attempt"] + 1
        else:
            outcome = "rejected"
        return command, outcome, s["status"], s["attempt"]

    def due(self, s):
        return s["seen"] + self.lease if self.lease is not None and s["status"] == "RUNNING" else None

    def expired(self, s, at):
        if s["status"] != "RUNNING":
            return None
        s["status"] = "RECOVERY_REQUIRED"
        return "lease", "applied", s["status"], s["attempt"]


class Breaker(Machine):
    """A breaker per agent: ``threshold`` failures in a row open it for ``cooldown`` microseconds; then it is half-open, one failure
    short of opening again. Calls while it is open are refused and count as nothing."""

    fields = "failures int, open_until long"
    gives = "allowed boolean, failures int, state string"

    def __init__(self, threshold: int, cooldown: int, live: bool = False):
        super().__init__(live)
        self.threshold, self.cooldown = max(1, threshold), cooldown

    def first(self):
        return {"failures": 0, "open_until": None}

    def _half(self, s):
        s["open_until"], s["failures"] = None, self.threshold - 1

    def step(self, s, row):
        at = s["last_at"]
        half = s["open_until"] is not None and at >= s["open_until"]
        if half:
            self._half(s)
        if s["open_until"] is not None:
            return False, s["failures"], "open"
        if row["ok"]:
            s["failures"] = 0
        else:
            s["failures"] += 1
            if s["failures"] >= self.threshold:
                s["open_until"] = at + self.cooldown
        return True, s["failures"], "open" if s["open_until"] is not None else "closed"

    def due(self, s):
        return s["open_until"]

    def expired(self, s, at):
        if s["open_until"] is None or at < s["open_until"]:
            return None
        self._half(s)
        return None, s["failures"], "half_open"


_DAY = 86_400_000_000


class Budget(Machine):
    """Batches under a daily budget. Commands: run (``requested``, ``pending``), finish (``assessed``, ``incomplete``), break (the batch
    raised an error), pause, resume. A batch fails as a whole if all it assessed is incomplete; ``threshold`` failures in a row
    start a cooldown, and an interrupted batch counts as one. Days are UTC."""

    fields = "paused boolean, running boolean, day long, spent long, failures int, cool_until long"
    gives = "command string, outcome string, granted long, spent long, failures int"

    def __init__(self, limit: int, threshold: int, cooldown: int, live: bool = False):
        super().__init__(live)
        self.limit, self.threshold, self.cooldown = max(1, limit), max(1, threshold), cooldown

    def first(self):
        return {"paused": False, "running": False, "day": None, "spent": 0, "failures": 0, "cool_until": None}

    def _failed(self, s, at):
        s["failures"] += 1
        s["cool_until"] = at + self.cooldown if s["failures"] >= self.threshold else None

    def step(self, s, row):
        command, granted, at = row["command"], None, s["last_at"]
        if command == INTERRUPTED:
            if not s["running"]:
                return None
            s["running"], s["failures"] = False, s["failures"] + 1
            return command, "recovered", None, s["spent"], s["failures"]
        if s["day"] != at // _DAY:
            s["day"], s["spent"] = at // _DAY, 0
        outcome = "applied"
        if command == "run":
            granted = min(max(0, int(row["requested"] or 0)), self.limit - s["spent"], int(row["pending"] or 0))
            if s["running"]:
                outcome = "busy"
            elif s["paused"]:
                outcome = "paused"
            elif s["cool_until"] is not None and at < s["cool_until"]:
                outcome = "cooldown"
            elif s["spent"] >= self.limit:
                outcome = "daily_limit"
            elif granted <= 0:
                outcome = "idle"
            else:
                s["running"], outcome = True, "started"
            granted = granted if outcome == "started" else 0
        elif command in ("finish", "break"):
            if not s["running"]:
                outcome = "ignored"
            else:
                s["running"] = False
                if command == "break":
                    self._failed(s, at)
                else:
                    assessed = int(row["assessed"] or 0)
                    s["spent"] += assessed
                    if assessed > 0 and int(row["incomplete"] or 0) == assessed:
                        self._failed(s, at)
                    else:
                        s["failures"], s["cool_until"] = 0, None
        elif command in ("pause", "resume"):
            s["paused"], s["running"] = command == "pause", False
            if command == "resume":
                s["failures"], s["cool_until"] = 0, None
        else:
            outcome = "ignored"
        return command, outcome, granted, s["spent"], s["failures"]

    def due(self, s):
        ends = [x for x in (s["cool_until"], (s["day"] + 1) * _DAY if s["spent"] >= self.limit else None) if x is not None]
        return max(ends) if ends else None

    def expired(self, s, at):
        if s["cool_until"] is not None and at >= s["cool_until"]:
            s["cool_until"] = None
        if s["day"] is not None and at >= (s["day"] + 1) * _DAY:
            s["day"], s["spent"] = at // _DAY, 0
        return "timer", "ready", None, s["spent"], s["failures"]


def machine(stream: DataFrame, processor: Machine, key_type: str = "long") -> DataFrame:
    """key, at (microseconds), event_id and what the machine gives. stream: key, at (microseconds), event_id and the machine's columns."""
    out = f"key {key_type}, at long, event_id long, {processor.gives}"
    return stream.groupBy("key").transformWithStateInPandas(processor, out, "append", "ProcessingTime" if processor.live else "none")


def interrupted(feed: Feed, under_way: str) -> DataFrame:
    """The command of a restart for each key whose state meets ``under_way`` (SQL over the state's fields), as rows of the feed."""
    found = feed.state("state").selectExpr("key.key AS key", "value.*").where(under_way).select("key")
    have = {"key": F.col("key"), "command": F.lit(INTERRUPTED)}
    return found.select(*[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in feed.schema])


def replayed(rows: DataFrame, processor: Machine, store: Store, batches: int, under_way: str | None = None) -> DataFrame:
    """The machine's results over batches 1 to ``batches``, restarted between them. ``under_way``: which states a restart interrupts."""
    kind = rows.schema["key"].dataType.simpleString()
    feed = Feed(rows, store)
    started = False
    for n in feed.batches(range(1, batches + 1)):
        if started and under_way:
            feed.add(interrupted(feed, under_way), f"restart={n}")
        feed.start(lambda stream: machine(stream, processor, kind))
        started = True
    if not started:
        return rows.sparkSession.createDataFrame([], f"key {kind}, at long, event_id long, {processor.gives}")
    return feed.results()
