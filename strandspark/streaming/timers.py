"""Workers that fall silent and tasks that never report: found by timers, without another event that would tell.

Streams need Spark's RocksDB state store (spark.sql.streaming.stateStore.providerClass), which keeps state and timers of
more workers than memory holds and writes them to the checkpoint, so a lost executor loses neither.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.intervals import previous

FOUND = "worker string, task string, found string, at timestamp"


class Watch(StatefulProcessor):
    """State of one worker: when it was heard of last, and by when each of its open tasks must be done."""

    def __init__(self, silence_ms: int, factor: float, least_ms: int, by_event: bool):
        self.silence, self.factor, self.least, self.by_event = silence_ms, factor, least_ms, by_event

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")
        self.tasks = handle.getMapState("tasks", "task string", "due long")

    def _open(self) -> dict[str, int]:
        return {k[0]: v[0] for k, v in self.tasks.iterator()}

    def _wait(self, now: int) -> None:
        """One timer for what comes first: silence or the first task that is due."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if self.last.exists():
            self.handle.registerTimer(max(now + 1, min([self.last.get()[0] + self.silence, *self._open().values()])))

    def _rows(self, worker: str, found: list[tuple[str | None, str]], now: int) -> pd.DataFrame:
        at = pd.Series([pd.Timestamp(now, unit="ms")] * len(found), dtype="datetime64[ns]")
        texts = {"worker": [worker] * len(found), "task": [t for t, _ in found], "found": [f for _, f in found]}
        return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in texts.items()} | {"at": at})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        clock = timerValues.getCurrentProcessingTimeInMs()
        frame = pd.concat(list(rows)).sort_values("ts", kind="stable")
        last = self.last.get()[0] if self.last.exists() else 0
        for ts, event, task, expected in zip(frame["ts"], frame["event"], frame["task"], frame["expected_ms"], strict=True):
            now = int(pd.Timestamp(ts).timestamp() * 1000) if self.by_event else clock
            last = max(last, now)
            if event == "assigned":
                self.tasks.updateValue((task,), (now + max(self.least, int(self.factor * (0 if pd.isna(expected) else expected))),))
            elif event == "done" and self.tasks.containsKey((task,)):
                self.tasks.removeKey((task,))
        self.last.update((last,))
        self._wait(timerValues.getCurrentWatermarkInMs() if self.by_event else clock)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        open_ = self._open()
        if self.last.exists() and now >= self.last.get()[0] + self.silence:
            yield self._rows(key[0], [(None, "lost"), *((t, "again") for t in sorted(open_))], now)
            self.last.clear()
            self.tasks.clear()
            return
        late = sorted(t for t, due in open_.items() if due <= now)
        for t in late:
            self.tasks.removeKey((t,))
        self._wait(now)
        if late:
            yield self._rows(key[0], [(t, "overdue") for t in late], now)


def watched(events: DataFrame, silence: int, factor: float = 3.0, least: int = 10, by_event: bool = False, late: str = "10 seconds") -> DataFrame:
    """(worker, task, found, at) of a stream of events (worker, ts, event, task, expected_ms), as soon as time tells.

    An event is a sign of life; ``assigned`` gives a task to the worker, ``done`` ends it. A worker silent for ``silence``
    seconds is ``lost``, and each of its open tasks is to be given out ``again``; a task that isn't done after ``factor``
    times its expected time, ``least`` seconds at least, is ``overdue``, once. Time is the cluster's clock, so that nothing
    else need happen; with ``by_event`` it is the events' own, as far as the watermark, ``late`` behind, has come. A lost worker's
    state is forgotten; an event brings it back. Rows without a worker are a worker too; a done task that wasn't open is only a sign of life.
    """
    slim = events.select(F.coalesce("worker", F.lit("")).alias("worker"), "ts", "event", "task", F.col("expected_ms").cast("double").alias("expected_ms"))
    slim = slim.withWatermark("ts", late) if by_event else slim
    processor = Watch(1000 * silence, factor, 1000 * least, by_event)
    return slim.groupBy("worker").transformWithStateInPandas(statefulProcessor=processor, outputStructType=FOUND, outputMode="Update", timeMode="EventTime" if by_event else "ProcessingTime")


def silences(events: DataFrame, worker: str, at: str, silence: int, until: Column) -> DataFrame:
    """(worker, last, lost_at) of a table: each stretch without an event of a worker for ``silence`` units of ``at`` or more.

    The stretch from a worker's last event to ``until`` counts too: what a stream's timers find. Places of events are compared
    in ranges, so no worker is one task.
    """
    slim = events.select(worker, F.col(at).alias("_at"))
    between = previous(slim, [worker], ["_at"], ["_at"]).where(F.col("_at") - F.col("_p__at") >= silence).select(worker, F.col("_p__at").alias("last"))
    ends = slim.groupBy(worker).agg(F.max("_at").alias("last")).where(until - F.col("last") >= silence)
    return between.unionByName(ends).select(worker, "last", (F.col("last") + silence).alias("lost_at"))


def unfinished(events: DataFrame, worker: str, task: str, assigned: Column, done: Column, at: str, allowed: Column, until: Column) -> DataFrame:
    """(task, worker, due) of a table's tasks that weren't done when they were due, by ``until`` at the latest: the batch form of ``overdue``.

    ``assigned`` and ``done`` say what an event is, ``allowed`` how long an assigned task may take.
    """
    given = events.where(assigned).select(task, worker, (F.col(at) + allowed).alias("due"))
    ended = events.where(done).groupBy(task).agg(F.min(at).alias("_done"))
    both = given.join(ended, task, "left")
    return both.where((F.col("due") <= until) & (F.col("_done").isNull() | (F.col("_done") > F.col("due")))).select(task, worker, "due")
