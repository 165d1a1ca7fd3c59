"""A scheduler that runs as a stream with timers of its own.

Definitions of schedules come as a stream of changes. The state of a schedule is its newest definition and its cursor (the next run); a
processing-time timer wakes it when that is due, and it gives its jobs by its catch-up policy, moves the cursor and sets the next timer.
State and timers are in the checkpoint: a query that is started again goes on from its cursors, so what fell due meanwhile is caught up once.
A batch that is repeated after a failure has the same clock and gives the same job ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from granary.operators.schedules import MAX_CATCH_UP, Runs, cursor_runs, enqueue
from granary.session import importable

DEFINITION = "version long, expression string, paused boolean, catch_up_policy string, target_id string, storage_id string, backup_type string, created_at timestamp_ntz"
CURSOR = "next_run timestamp_ntz"
RUNS = "id string, target_id string, storage_id string, backup_type string, due_at timestamp_ntz, now timestamp_ntz, next_run timestamp_ntz, problem string"
EPOCH = datetime(1970, 1, 1)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_timers(spark: SparkSession) -> None:
    """State with timers needs the RocksDB store; queries started in this session use it from now on."""
    importable(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def instant(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, UTC).replace(tzinfo=None)


def millis(at: datetime) -> int:
    """The first whole millisecond not before an instant."""
    return -((EPOCH - at) // timedelta(milliseconds=1))


class Scheduler(StatefulProcessor):
    """limit: a schedule with more runs to catch up gives a problem instead, and waits for another definition."""

    def __init__(self, limit: int = MAX_CATCH_UP):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.runs = handle, {}
        self.definition, self.cursor = handle.getValueState("definition", DEFINITION), handle.getValueState("cursor", CURSOR)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        """The newest change counts; the cursor stays, whatever the definition says now."""
        newest = max(rows, key=lambda r: r.version)
        known = self.definition.get()
        if known and known[0] > newest.version:
            return
        self._quiet()
        if newest.deleted:
            self.definition.clear()
            self.cursor.clear()
            return
        self.definition.update((newest.version, newest.expression, bool(newest.paused), newest.catch_up_policy, newest.target_id, newest.storage_id, newest.backup_type, newest.created_at))
        yield from self._tick(key[0], instant(timerValues.getCurrentProcessingTimeInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._tick(key[0], instant(timerValues.getCurrentProcessingTimeInMs()))

    def close(self) -> None:
        pass

    def _quiet(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def _tick(self, id: str, now: datetime) -> Iterator[Row]:
        known = self.definition.get()
        if not known or known[2]:
            return
        _, expression, _, policy, target, storage, kind, created = known
        at = self.cursor.get()
        try:
            if expression not in self.runs:
                if len(self.runs) > 10_000:
                    self.runs.clear()
                self.runs[expression] = Runs(expression)
            found, following = cursor_runs(self.runs[expression], id, at[0] if at else None, created or now, now, self.limit)
        except ValueError as e:
            yield Row(id=id, target_id=target, storage_id=storage, backup_type=kind, due_at=None, now=now, next_run=None, problem=str(e))
            return
        self.cursor.update((following,))
        self.handle.registerTimer(millis(following))
        for due in found if policy == "queue" else [now] * bool(found) if policy == "run_once" else found[-1:]:
            yield Row(id=id, target_id=target, storage_id=storage, backup_type=kind, due_at=due, now=now, next_run=following, problem=None)


def due_runs(definitions: DataFrame, limit: int = MAX_CATCH_UP) -> DataFrame:
    """Runs as they fall due, from a stream of changes (id, version, expression, paused, catch_up_policy, target_id, storage_id, backup_type, created_at, deleted)."""
    with_timers(definitions.sparkSession)
    return definitions.groupBy("id").transformWithState(Scheduler(limit), RUNS, "Append", "ProcessingTime")


def queued_jobs(definitions: DataFrame, limit: int = MAX_CATCH_UP) -> DataFrame:
    """Queued jobs of the runs that fall due."""
    runs = due_runs(definitions, limit).where("problem is null")
    return enqueue(runs, F.col("now"))
