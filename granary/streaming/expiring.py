"""Keyed states that end: agents that fall silent, clients whose window has run out.

Timers in event time (the watermark) end what a key holds, so the state is as large as the keys that were heard of lately, and a replay gives the same
rows as the stream did."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from granary.streaming.scheduler import with_timers

AGENTS = "agent_id string, capacity int, micros long, status string"
DECIDED = "client string, id long, micros long, allowed boolean"




class Agents(StatefulProcessor):
    """The last heartbeat to arrive of an agent counts, whatever its instant; degraded when more than `late` has passed since, forgotten when more than `gone` has."""

    def __init__(self, late: timedelta, gone: timedelta):
        self.late, self.gone = late, gone

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "arrival long, capacity int, micros long, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = max(rows, key=lambda r: r.arrival)
        known = self.last.get()
        if known and known[0] > newest.arrival:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((newest.arrival, newest.capacity, newest.micros, "healthy"))
        yield Row(agent_id=key[0], capacity=newest.capacity, micros=newest.micros, status="healthy")
        self.handle.registerTimer(self._after(newest.micros, self.late))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.last.get()
        if not known:
            return
        arrival, capacity, at, status = known
        if status == "healthy":
            self.last.update((arrival, capacity, at, "degraded"))
            self.handle.registerTimer(self._after(at, self.gone))
        else:
            self.last.clear()
        yield Row(agent_id=key[0], capacity=capacity, micros=at, status="degraded" if status == "healthy" else "gone")

    def close(self) -> None:
        pass

    @staticmethod
    def _after(micros: int, wait: timedelta) -> int:
        return (micros + wait // timedelta(microseconds=1)) // 1000 + 1


def agents(heartbeats: DataFrame, late_seconds: int = 30, gone_seconds: int = 300) -> DataFrame:
    """A row for each change of an agent's status (healthy, degraded, gone), from heartbeats (agent_id, capacity, heartbeat_at, arrival) with a watermark on heartbeat_at."""
    if gone_seconds < late_seconds:
        raise ValueError("an agent is degraded before it is gone")
    with_timers(heartbeats.sparkSession)
    given = heartbeats.select("agent_id", "capacity", "heartbeat_at", "arrival", F.unix_micros("heartbeat_at").alias("micros"))
    told = given.groupBy("agent_id").transformWithState(Agents(timedelta(seconds=late_seconds), timedelta(seconds=gone_seconds)), AGENTS, "Update", "EventTime")
    return told.select("agent_id", "capacity", F.timestamp_micros("micros").alias("heartbeat_at"), "status")


class Limiter(StatefulProcessor):
    """Of a client's requests in a window that starts with the first one, so many are let through. The state goes when the window has run out."""

    def __init__(self, width: timedelta, limit: int):
        self.width, self.limit = width // timedelta(microseconds=1), limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.window = handle, handle.getValueState("window", "start long, n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.window.get()
        start, n = known or (None, 0)
        before = start
        for at, id in sorted((r.micros, r.id) for r in rows):
            if start is None or at - start >= self.width:
                start, n = at, 0
            allowed = n < self.limit
            n += allowed
            yield Row(client=key[0], id=id, micros=at, allowed=allowed)
        if start != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(-(-(start + self.width) // 1000))
        self.window.update((start, n))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


def limited(requests: DataFrame, window_seconds: int, limit: int) -> DataFrame:
    """requests (client, id, at) with `allowed`; at has the watermark, and requests behind it are dropped by Spark. Of a batch a client's (at, id) are held in memory."""
    with_timers(requests.sparkSession)
    given = requests.select("client", "id", "at", F.unix_micros("at").alias("micros"))
    told = given.groupBy("client").transformWithState(Limiter(timedelta(seconds=window_seconds), limit), DECIDED, "Append", "EventTime")
    return told.select("client", "id", F.timestamp_micros("micros").alias("at"), "allowed")
