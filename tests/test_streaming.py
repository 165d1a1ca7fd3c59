"""Streams are replayed from files, a batch each, and must agree with their batch twins."""

from __future__ import annotations

import time
from collections import defaultdict
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from granary.operators import replay, schedules
from granary.streaming import expiring, scheduler, stateful


@pytest.fixture
def events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


def replayed(spark, df, path, order, batches=3):
    n = df.count()
    step = -(-n // batches)
    rows = df.orderBy(order).collect()
    for i in range(batches):
        spark.createDataFrame(rows[i * step : (i + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def followed(df, path, mode):
    """All rows that a stream over files gives, and its last progress."""
    got = []
    q = df.writeStream.outputMode(mode).foreachBatch(lambda b, n: got.extend((n, r) for r in b.collect())).option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return got, q.lastProgress


def test_agents(spark, events, tmp_path):
    """The last heartbeat to arrive counts; the silent are degraded, then gone, and leave no state."""
    hb = events.where("event_type = 'view'").select(F.concat(F.lit("a-"), (F.col("user_id") % 7).cast("string")).alias("agent_id"), (F.col("event_id") % 4).cast("int").alias("capacity"), F.col("ts").cast("timestamp").alias("heartbeat_at"), F.col("event_id").alias("arrival"))
    stream = replayed(spark, hb, str(tmp_path), "heartbeat_at").withWatermark("heartbeat_at", "0 seconds")
    got, _ = followed(expiring.agents(stream, 30, 10**8), str(tmp_path), "update")
    last = {r.agent_id: (r.capacity, r.heartbeat_at) for _, r in got if r.status == "healthy"}
    top = {}
    for r in hb.collect():
        if r.agent_id not in top or r.arrival > top[r.agent_id][0]:
            top[r.agent_id] = (r.arrival, (r.capacity, r.heartbeat_at))
    assert last == {k: v for k, (_, v) in top.items()}


def test_silent_agents_leave_no_state(spark, tmp_path):
    start = datetime(2026, 4, 25, 12)
    beat = lambda who, s, n: (who, 1, start + timedelta(seconds=s), n)
    many = [beat(f"m{i}", i % 10, 100 + i) for i in range(500)]
    batches = [[beat("fresh", 0, 1), beat("stale", -600, 2), *many], [beat("fresh", 31, 3)], [beat("fresh", 61, 4)], [beat("fresh", 420, 5)], [beat("back", 421, 6), beat("fresh", 430, 7)], [beat("fresh", 2000, 8)], [beat("fresh", 2001, 9)]]
    for b in batches:
        spark.createDataFrame(b, "agent_id string, capacity int, heartbeat_at timestamp, arrival long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("agent_id string, capacity int, heartbeat_at timestamp, arrival long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("heartbeat_at", "0 seconds")
    got, progress = followed(expiring.agents(stream, 30, 300), str(tmp_path), "update")
    told = defaultdict(list)
    for _, r in got:
        told[r.agent_id].append(r.status)
    assert told["stale"] == ["healthy", "degraded", "gone"] and told["back"] == ["healthy", "degraded", "gone"]
    assert all(told[f"m{i}"] == ["healthy", "degraded", "gone"] for i in range(500))
    assert told["fresh"][-1] == "healthy" or told["fresh"][-2:] == ["healthy", "degraded"]
    assert progress["stateOperators"][0]["numRowsTotal"] < 20
    with pytest.raises(ValueError):
        expiring.agents(stream, 30, 10)


def test_rate_limit(spark, events, tmp_path):
    requests = events.select((F.col("user_id") % 10).cast("string").alias("client"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"))
    stream = replayed(spark, requests, str(tmp_path), "at").withWatermark("at", "0 seconds")
    got, _ = followed(expiring.limited(stream, 86400, 3), str(tmp_path), "append")
    want = {r.id: r.allowed for r in replay.rate_limited(requests, "client", "at", 86400, 3, "id").collect()}
    assert {r.id: r.allowed for _, r in got} == want and len(got) == len(want)


def test_windows_that_ran_out_leave_no_state(spark, tmp_path):
    start = datetime(2026, 4, 25)
    for day in range(5):
        rows = [(f"c{day}-{i % 400}", day * 10_000 + i, start + timedelta(days=day, seconds=i)) for i in range(1600)]
        spark.createDataFrame(rows, "client string, id long, at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("client string, id long, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("at", "0 seconds")
    got, progress = followed(expiring.limited(stream, 3600, 3), str(tmp_path), "append")
    assert len(got) == 8000 and sum(r.allowed for _, r in got) == 5 * 400 * 3
    assert progress["stateOperators"][0]["numRowsTotal"] <= 2 * 400 * 4  # of 2,000 clients, those of a day with their timers


# the scheduler as a stream

DEFINED = "id string, version long, expression string, paused boolean, catch_up_policy string, target_id string, storage_id string, backup_type string, created_at timestamp_ntz, deleted boolean"


def utc():
    return datetime.now(UTC).replace(tzinfo=None)


def define(spark, path, rows):
    spark.createDataFrame(rows, DEFINED).coalesce(1).write.mode("append").parquet(f"{path}/in")


def running(spark, path, seconds, got):
    """The scheduler for so long; what it queues goes to got, by batch: one that is repeated after the stop replaces itself."""
    stream = spark.readStream.schema(DEFINED).parquet(f"{path}/in")
    q = scheduler.due_runs(stream).writeStream.outputMode("append").foreachBatch(lambda b, n: got.__setitem__(n, b.collect())).option("checkpointLocation", f"{path}/c").trigger(processingTime="300 milliseconds").start()
    end = time.time() + seconds
    while time.time() < end and q.isActive:
        time.sleep(0.2)
    q.stop()
    q.awaitTermination(20)
    assert q.exception() is None


def test_scheduler_stream(spark, tmp_path):
    """Stopped and started again it neither repeats nor loses a run; policies, pauses and changes hold."""
    created = (utc() - timedelta(seconds=30)).replace(microsecond=0)
    row = lambda id, version=1, expression="* * * * * *", paused=False, policy="queue", deleted=False: (id, version, expression, paused, policy, "t", "s", "full", created, deleted)
    define(spark, tmp_path, [row("queue"), row("skip", policy="skip"), row("once", policy="run_once"), row("paused", paused=True), row("bad", expression="61 * * * *"), row("yearly", expression="0 0 1 1 *"), row("goes"), row("late", expression="*/2 * * * * *")])
    got = {}
    running(spark, tmp_path, 12, got)
    before, stopped = dict(got), utc()
    define(spark, tmp_path, [row("goes", 2, deleted=True), row("paused", 2), row("late", 0, paused=True)])
    time.sleep(3)
    running(spark, tmp_path, 12, got)
    assert all(sorted(map(str, got[n])) == sorted(map(str, rows)) for n, rows in before.items())  # a repeated batch gives the same
    first, second = [r for rows in before.values() for r in rows], [r for n, rows in got.items() if n not in before for r in rows]
    rows = [r for r in first + second if r.problem is None]
    due = defaultdict(list)
    for r in rows:
        due[r.id].append(r.due_at)
    now = max(r.now for r in rows if r.id == "queue")
    state = spark.createDataFrame([("queue", "* * * * * *", False, created, None, None), ("late", "*/2 * * * * *", False, created, None, None)], "id string, expression string, paused boolean, created_at timestamp_ntz, last_run timestamp_ntz, next_run timestamp_ntz")
    batch = defaultdict(list)
    for r in schedules.due(state, now).collect():
        batch[r.id].append(r.due_at)
    assert sorted(due["queue"]) == sorted(batch["queue"]) and len(due["queue"]) == len(set(due["queue"])) > 40
    assert len(due["late"]) == len(set(due["late"])) and set(due["late"]) <= set(batch["late"]) and len(batch["late"]) - len(due["late"]) <= 1  # an older version changes nothing
    for id in ("skip", "once"):
        assert len(due[id]) == len({r.now for r in rows if r.id == id}) and due[id] == sorted(set(due[id]))  # one a tick
    assert max((b - a).total_seconds() for a, b in zip(due["skip"], due["skip"][1:], strict=False)) >= 3  # what was missed meanwhile is one run
    assert all(r.due_at == r.now for r in rows if r.id == "once")
    assert due["goes"] and not [r for r in second if r.id == "goes" and r.now > stopped + timedelta(seconds=9)]
    assert not [r for r in first if r.id == "paused"] and len(due["paused"]) == len(set(due["paused"])) > 30
    assert [r.problem for r in first if r.id == "bad"] and "yearly" not in due


def test_scheduler_gives_the_jobs_of_its_batch_twin(spark, tmp_path):
    created = (utc() - timedelta(seconds=100)).replace(microsecond=0)
    define(spark, tmp_path, [("a", 1, "*/5 * * * * *", False, "queue", "t", "s", "full", created, False)])
    got = []
    q = scheduler.queued_jobs(spark.readStream.schema(DEFINED).parquet(f"{tmp_path}/in")).writeStream.foreachBatch(lambda b, n: got.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="300 milliseconds").start()
    end = time.time() + 60
    while not got and time.time() < end:
        time.sleep(0.2)
    q.stop()
    now = got[0].queued_at
    runs = schedules.due(spark.createDataFrame([("a", "*/5 * * * * *", False, created, None, None)], "id string, expression string, paused boolean, created_at timestamp_ntz, last_run timestamp_ntz, next_run timestamp_ntz"), now)
    runs = runs.selectExpr("id", "'t' as target_id", "'s' as storage_id", "'full' as backup_type", "'queue' as catch_up_policy", "due_at")
    twin = schedules.enqueue(schedules.catch_up(runs, str(now)), str(now)).collect()
    assert {tuple(r) for r in twin} == {tuple(r) for r in got if r.queued_at == now} and len(twin) >= 20


def test_apply_changes(spark, events, tmp_path):
    changes = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("place"), F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("operation"), "value")
    stream = replayed(spark, changes, str(tmp_path), "place")
    stateful.apply_changes(stream, str(tmp_path / "out"), ["key"], "place", str(tmp_path / "c"), compact=2).trigger(availableNow=True).start().awaitTermination()
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out" / "changes").iterdir())
    got = {r.key: r.value for r in stateful.current(spark, str(tmp_path / "out"), ["key"], "place").collect()}
    want = {r.key: r.value for r in replay.applied(changes, ["key"], ["place"]).collect()}
    assert got == want and last >= 1 and (tmp_path / "out" / "base").exists()


def test_change_log_resumes(spark, tmp_path):
    import json

    from granary.session import importable
    from granary.sources.changes import ChangeLog

    importable(spark)
    spark.dataSource.register(ChangeLog)
    log = tmp_path / "log"
    log.mkdir()

    def write(first, last):
        (log / f"{first:08}.jsonl").write_text("".join(json.dumps({"position": p, "time": "2026-04-25T10:00:00", "operation": "insert", "key": f"k{p}", "payload": {"v": p}}) + "\n" for p in range(first, last + 1)))

    write(1, 5)
    write(6, 9)
    batch = spark.read.format("change_log").option("path", str(log)).option("after", "3").option("to", "7").load()
    assert sorted(r.position for r in batch.collect()) == [4, 5, 6, 7]

    def run():
        stream = spark.readStream.format("change_log").option("path", str(log)).option("after", "2").load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.position for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [3, 4, 5, 6, 7, 8, 9]
    write(10, 12)
    assert run() == list(range(3, 13))
