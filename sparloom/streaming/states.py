"""Keyed state machines in streams: the fold of mission events, and sessions that expire by timer.

Both fold what is the last by a sequence number or an interval, so that neither the order of rows within a batch nor
how batches are cut changes the result, and no batch's rows of a key are held. Survey rows: STR-04, STR-05, STR-09,
EVT-01.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MISSION = "mission {kind}, rounds int, evidence long, gate string, events long, open_questions long, running long, paused long, interrupted long"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that begin here keep their state in a store that holds more than memory does."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def status(base_at: int, base: str | None, paused_at: int, acked_at: int) -> str | None:
    """A task's status: its last report or stop, unless a later pause holds or was acknowledged."""
    if paused_at > base_at:
        return "running" if acked_at > paused_at else "paused"
    return base


class Missions(StatefulProcessor):
    """The state of each mission; counts are kept, so that a batch touches the questions and tasks it names only."""

    COUNTED = ("running", "paused", "interrupted")

    def __init__(self, ttl_ms: int | None = None):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        whole = "rounds int, evidence long, gate_at long, gate string, events long, first_at long, first string, open long, running long, paused long, interrupted long"
        self.whole = handle.getValueState("mission", whole, self.ttl)
        self.questions = handle.getMapState("questions", "key string", "at long, value string", self.ttl)
        self.tasks = handle.getMapState("tasks", "key string", "base_at long, base string, paused_at long, acked_at long", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        names = ("rounds", "evidence", "gate_at", "gate", "events", "first_at", "first", "open", *self.COUNTED)
        s = dict(zip(names, self.whole.get() if self.whole.exists() else (0, 0, -1, None, 0, 2**62, None, 0, 0, 0, 0)))
        questions: dict[str, tuple] = {}
        tasks: dict[str, list] = {}
        for r in rows:
            kind, at, value = r["type"], r["seq"], r["value"]
            s["events"] += 1
            if at < s["first_at"]:
                s["first_at"], s["first"] = at, kind
            if kind == "round.started":
                s["rounds"] = max(s["rounds"], int(value) if value and value.strip().lstrip("+-").isdigit() else 0)
            elif kind == "evidence.recorded":
                s["evidence"] += 1
            elif kind.startswith("gate."):
                if at > s["gate_at"]:
                    s["gate_at"], s["gate"] = at, kind
            elif kind.startswith("question."):
                questions[r["key"]] = max(questions.get(r["key"], (-1, None)), (at, value), key=lambda x: x[0])
            elif kind.startswith("task.") or kind.startswith("control."):
                t = tasks.setdefault(r["key"], [-1, None, -1, -1])
                sent = kind == "control.message_sent"
                if (kind.startswith("task.") or sent and value == "immediate_stop") and at > t[0]:
                    t[0], t[1] = at, value if kind.startswith("task.") else "interrupted"
                elif value == "pause_until_ack" and sent:
                    t[2] = max(t[2], at)
                elif value == "pause_until_ack" and kind == "control.message_acknowledged":
                    t[3] = max(t[3], at)
        if s["first"] != "mission.started":
            raise ValueError(f"an event before the start of mission {key[0]}")
        for name, new in questions.items():
            old = tuple(self.questions.getValue((name,))) if self.questions.containsKey((name,)) else (-1, None)
            last = max(old, new, key=lambda x: x[0])
            s["open"] += (last[1] == "open") - (old[1] == "open")
            self.questions.updateValue((name,), last)
        for name, new in tasks.items():
            old = tuple(self.tasks.getValue((name,))) if self.tasks.containsKey((name,)) else (-1, None, -1, -1)
            base = max(old[:2], tuple(new[:2]), key=lambda x: x[0])
            last = (*base, max(old[2], new[2]), max(old[3], new[3]))
            for state, step in ((status(*old), -1), (status(*last), 1)):
                if state in self.COUNTED:
                    s[state] += step
            self.tasks.updateValue((name,), last)
        self.whole.update(tuple(s[n] for n in names))
        yield Row(mission=key[0], rounds=s["rounds"], evidence=s["evidence"], gate=s["gate"], events=s["events"], open_questions=s["open"], running=s["running"], paused=s["paused"], interrupted=s["interrupted"])

    def close(self) -> None:
        pass


def missions(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """The state of the missions whose events (mission, seq, type, key, value) a batch brings, for update mode; equal to
    ``reviews.mission_states`` of all events so far. A mission whose first event isn't its start fails the stream. With
    ttl_ms, what was not touched for so long is forgotten; run such a stream batch by batch, not to an end."""
    kind = dict(events.dtypes)["mission"]
    return events.groupBy("mission").transformWithState(Missions(ttl_ms), MISSION.format(kind=kind), "Update", "ProcessingTime" if ttl_ms else "None")


class Idle(StatefulProcessor):
    """Runs of a key's events with no gap over ``idle`` microseconds, put out by a timer when time has passed."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getValueState("runs", "first array<long>, last array<long>, n array<long>")

    def _held(self) -> list[list[int]]:
        return [list(x) for x in zip(*self.runs.get())] if self.runs.exists() else []

    def _keep(self, runs: list[list[int]]) -> None:
        if runs:
            self.runs.update(tuple(list(x) for x in zip(*runs)))
        else:
            self.runs.clear()

    def _over(self, last: int) -> int:
        return -((-last - self.idle) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        runs = self._held()
        for r in rows:
            at = r["micros"]
            k = bisect_left(runs, [at])
            new = [at, at, 1]
            # at most one run on either side is near enough
            if k < len(runs) and runs[k][0] - at <= self.idle:
                new = [at, runs[k][1], runs[k][2] + 1]
                runs.pop(k)
            if k and new[0] - runs[k - 1][1] <= self.idle:
                k -= 1
                new = [runs[k][0], max(runs[k][1], new[1]), runs[k][2] + new[2]]
                runs.pop(k)
            runs.insert(k, new)
        for _, last, _ in runs:
            self.handle.registerTimer(self._over(last))
        self._keep(runs)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        runs = self._held()
        for first, last, n in runs:
            if self._over(last) <= now:
                yield Row(user_id=key[0], first=first, last=last, n=n)
        self._keep([r for r in runs if self._over(r[1]) > now])

    def close(self) -> None:
        pass


def idle_sessions(events: DataFrame, idle_seconds: int, late: str = "1 day") -> DataFrame:
    """user_id, first, last (microseconds), n of runs of a user's events (user_id, ts), put out and forgotten once no
    event can join them: when the watermark is ``idle_seconds`` past their last one (append mode)."""
    timed = events.select("user_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("micros", F.unix_micros("ts")).withWatermark("ts", late)
    kind = dict(events.dtypes)["user_id"]
    return timed.groupBy("user_id").transformWithState(Idle(idle_seconds * 1_000_000), f"user_id {kind}, first long, last long, n long", "Append", "EventTime")
