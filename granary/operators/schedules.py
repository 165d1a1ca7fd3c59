"""Schedules: cursors, due runs, catch-up and the jobs that come of them."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import cron
from granary.session import importable

MAX_CATCH_UP = 1000
NEVER, DAY = np.iinfo(np.int64).min, 86_400_000_000  # no instant (numpy's NaT), and a day's microseconds


def with_cursors(schedules: DataFrame, states: DataFrame) -> DataFrame:
    """Schedules with their stored cursor, or a fresh one; what the schedule says overrides what the state says."""
    return schedules.join(states.select("id", "last_run", "next_run"), "id", "left").withColumn("seed", F.coalesce("last_run", "created_at"))


def minute_runs(schedules: DataFrame, expression: str, start: str, end: str) -> DataFrame:
    """All runs of one expression in [start, end], for each schedule not paused: a minute grid, filtered once."""
    grid = schedules.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), F.expr("interval 1 minute"))).alias("due_at"))
    hits = grid.where(cron.minute_fits(cron.parse(expression), F.col("due_at")))
    # the runs of one expression in a span are few (a minute each at most); every schedule gets the array of them
    row = hits.agg(F.sort_array(F.collect_list("due_at")).alias("runs"))
    active = schedules.where("not paused").crossJoin(F.broadcast(row))
    return active.select("*", F.explode("runs").alias("due_at")).drop("runs").where("due_at > created_at")


class Runs:
    """Runs of one expression after any instants: what one instant needs is kept for the next ones."""

    def __init__(self, expression: str):
        self.window = cron.parse_window(expression) if expression.strip().startswith("@between") else None
        self.cron = None if self.window else cron.parse(expression)
        self.known: list[datetime] = []  # all runs after `since`, up to the last of them
        self.since: datetime | None = None

    def step(self, after: datetime, key: str) -> datetime:
        return cron.next_window(self.window, after, key) if self.window else cron.next_run(self.cron, after)

    def due(self, key: str, after: datetime, now: datetime, limit: int) -> tuple[list[datetime], datetime]:
        """Runs after an instant up to now, `limit` + 1 at most, and the first one that is not among them."""
        known = self.known
        if self.window and self.window.random or self.since is None or after < self.since or not known or after >= known[-1]:
            known, self.since = [self.step(after, key)], after  # drawn for each key; or an instant outside what is known
        first = i = bisect_right(known, after)
        while known[i] <= now and i - first <= limit:
            i += 1
            if i == len(known):
                known.append(self.step(known[-1], key))
        out = known[first:i], known[i]
        if first > 10_000:
            self.since, known = known[first - 1], known[first:]
        self.known = known
        return out


def cursor_runs(runs: Runs, key: str, cursor: datetime | None, seed: datetime, now: datetime, limit: int) -> tuple[list[datetime], datetime]:
    """(runs due up to now, the next one) of a schedule that waits for the run at `cursor`, or without one starts after `seed`."""
    if cursor is not None and cursor > now:
        return [], cursor
    found, following = runs.due(key, seed if cursor is None else cursor, now, limit)
    found = ([] if cursor is None else [cursor]) + found
    if len(found) > limit:
        raise ValueError(f"more than {limit} runs to catch up")
    return found, following


def window_runs(w: cron.Window, keys: list[str], cursor: np.ndarray, after: np.ndarray, now: datetime, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(places of keys, their counts of runs, all their runs in order, what follows for each) as `cursor_runs` gives them, for a window with instants drawn for each key.

    Instants are microseconds; cursor: NEVER where there is none, after: the cursor or the seed. Keys are left out that have too many runs, or start far
    from now, or have days on which clocks change about midnight."""
    until = int(np.datetime64(now, "us").astype(np.int64))
    waiting = np.flatnonzero(cursor > until)
    if len(waiting):
        yield waiting, np.zeros(len(waiting), np.int64), np.zeros(0, np.int64), cursor[waiting]
    rest = np.flatnonzero((cursor <= until) & (after > until - (limit + 2) * DAY) & (after < until + 1000 * DAY))
    if not len(rest):
        return
    span = np.array([after[rest].min(), max(until, after[rest].max())]).astype("datetime64[us]").tolist()
    days = cron.WindowDays(w, *span)
    first = days.day(after[rest])
    last = np.maximum(first, days.day(np.array(until))) + 1
    ok = days.plain(first, last)
    rest, first, last = rest[ok], first[ok], last[ok]
    drawn = cron.fnv1a_all([f"{keys[i]}:".encode() for i in rest])
    total, at = np.cumsum(last - first + 1), 0
    while at < len(rest):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 100_000, "right")))
        n = (last - first + 1)[at:to]
        of = np.repeat(np.arange(at, to), n)
        day = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]
        runs = days.instants(drawn[of], day)
        later = runs > after[rest[of]]
        found = later & (runs <= until)
        following = np.minimum.reduceat(np.where(later & ~found, runs, np.iinfo(np.int64).max), np.cumsum(n) - n)
        starts = cursor[rest[at:to]] != NEVER
        runs, of = np.concatenate([cursor[rest[at:to]][starts], runs[found]]), np.concatenate([np.arange(at, to)[starts], of[found]])
        order = np.argsort(of, kind="stable")  # a cursor before what comes after it
        count = np.bincount(of - at, minlength=to - at)
        few = count <= limit
        yield rest[at:to][few], count[few], runs[order][few[of[order] - at]], following[few]
        at = to


def due(states: DataFrame, now: datetime, limit: int = MAX_CATCH_UP, keep: tuple[str, ...] = ()) -> DataFrame:
    """states (id, expression, paused, created_at, last_run, next_run) to due instants up to now: (id, due_at, place, n, next_run, problem), and the columns
    of states that `keep` names (so that runs need no join to their schedules).

    Schedules are spread over all tasks, as stepping through runs costs more than moving them. Each expression is parsed once in the task that has it, and its
    runs are stepped through once for all schedules that share it; runs drawn for each schedule are worked out for a batch of schedules at once. A schedule with more than `limit` due instants, or one that can't be read, gives one row with a problem."""
    spark = states.sparkSession
    importable(spark)
    given = states.where("not coalesce(paused, false)").select("id", "expression", "created_at", "last_run", "next_run", *[F.col(c).alias(f"__{c}") for c in keep])
    spread = given.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("id"))
    stamp = pa.timestamp("us")
    kept = [f for c in keep for f in states.schema.fields if f.name == c]
    schema = T.StructType([*T._parse_datatype_string("id string, due_at timestamp_ntz, place int, n int, next_run timestamp_ntz, problem string").fields, *kept])

    def flat(batch: pa.RecordBatch, rows: list, dues: list | np.ndarray, counts: list, following: list, problems: list) -> pa.RecordBatch:
        n = np.array(counts, np.int64)
        times = np.maximum(n, 1)
        of = np.repeat(np.arange(len(n)), times)
        place = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
        at = pa.array(np.array(rows, np.int64)[of])
        by_row = lambda values, kind: pa.array(values, kind).take(pa.array(of))
        columns = [batch.column(0).take(at), pa.array(dues, stamp), pa.array(place, pa.int32(), mask=n[of] == 0), pa.array(n[of], pa.int32()), by_row(following, stamp), by_row(problems, pa.string())]
        return pa.RecordBatch.from_arrays([*columns, *[c.take(at) for c in batch.columns[5:]]], names=schema.names)

    def drawn(expressions: list[str], parsed: dict[str, Runs]) -> dict[str, list[int]]:
        """Places of each expression whose runs are drawn for each key."""
        out: dict[str, list[int]] = {}
        for i, e in enumerate(expressions):
            if e is not None and e.strip().startswith("@between"):
                out.setdefault(e, []).append(i)
        for e in list(out):
            try:
                if e not in parsed:
                    parsed[e] = Runs(e)
            except ValueError:
                del out[e]
        return {e: rows for e, rows in out.items() if parsed[e].window.random}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, Runs] = {}
        for batch in batches:
            ids, expressions, *times = [c.to_pylist() for c in batch.columns[:5]]
            seeds = [next_run or last or created or now for created, last, next_run in zip(*times, strict=True)]
            done = set()
            for expression, rows in drawn(expressions, parsed).items():
                micros = lambda values: np.array(values, "datetime64[us]").astype(np.int64)
                cursor, after = micros([times[2][i] for i in rows]), micros([seeds[i] for i in rows])
                for of, counts, runs, following in window_runs(parsed[expression].window, [ids[i] for i in rows], cursor, after, now, limit):
                    of = np.array(rows)[of]
                    dues = np.full(np.maximum(counts, 1).sum(), np.datetime64("NaT"), "datetime64[us]")
                    dues[np.repeat(counts > 0, np.maximum(counts, 1))] = runs.astype("datetime64[us]")
                    done.update(of.tolist())
                    yield flat(batch, of, dues, counts, following.astype("datetime64[us]"), [None] * len(of))
            order = sorted((i for i in range(len(ids)) if i not in done), key=seeds.__getitem__)
            rows, dues, counts, following, problems = [], [], [], [], []
            for i in order:
                try:
                    if expressions[i] not in parsed:
                        parsed[expressions[i]] = Runs(expressions[i])
                    found, next_, problem = *cursor_runs(parsed[expressions[i]], ids[i], times[2][i], seeds[i], now, limit), None
                except ValueError as e:
                    found, next_, problem = [], None, str(e)
                rows.append(i)
                dues += found or [None]
                counts.append(len(found))
                following.append(next_)
                problems.append(problem)
                if len(dues) > 100_000:  # a schedule may have `limit` of them
                    yield flat(batch, rows, dues, counts, following, problems)
                    rows, dues, counts, following, problems = [], [], [], [], []
            if rows:
                yield flat(batch, rows, dues, counts, following, problems)

    return spread.mapInArrow(work, schema)


def catch_up(runs: DataFrame, now: str) -> DataFrame:
    """runs (id, due_at, catch_up_policy, ...) by policy: queue keeps all, run_once one at now, skip (and anything else) the last.

    Of runs with the places that `due` gives (place, n) only those that may stay are exchanged."""
    queue = F.coalesce(F.col("catch_up_policy") == "queue", F.lit(False))
    df = runs.where(queue | (F.col("place") == F.col("n") - 1)) if {"place", "n"} <= set(runs.columns) else runs
    df = df.withColumn("__last", F.max("due_at").over(Window.partitionBy("id"))).where(queue | (F.col("due_at") == F.col("__last")))
    return df.withColumn("due_at", F.when(F.col("catch_up_policy") == "run_once", F.lit(now).cast("timestamp_ntz")).otherwise(F.col("due_at"))).drop("__last")


def enqueue(runs: DataFrame, now: str | Column) -> DataFrame:
    """Queued jobs; ids follow from schedule and instant, so that a repeated run of the plan gives the same ones."""
    return runs.select(
        F.concat(F.lit("j-"), F.substring(F.sha2(F.concat_ws("|", "id", F.col("due_at").cast("string")), 256), 1, 24)).alias("job_id"), F.col("id").alias("schedule_id"), "target_id", "storage_id",
        F.col("backup_type").alias("type"), F.lit("backup").alias("operation"), F.lit("queued").alias("status"), "due_at", (F.lit(now) if isinstance(now, str) else now).cast("timestamp_ntz").alias("queued_at"),
    )
