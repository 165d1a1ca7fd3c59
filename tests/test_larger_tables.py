"""What shows on larger tables only: several batches in a task, many requests for a target, logs in several ranges."""

from __future__ import annotations

import itertools
import os
import random
import re
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary import queries
from granary.functions import chunking, statements
from granary.operators import integrity, lineage, schedules
from granary.plans import backup, fixtures
from granary.sources import objects


@pytest.fixture
def small_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    yield spark
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_known_runs_serve_earlier_instants_too():
    now = datetime(2024, 1, 5)
    for expression in ("5 * * * *", "@between 02:00-04:00 UTC"):
        kept = schedules.Runs(expression)
        for hours in (1, 30, 9, 31, 3, 60, 2, 40, 90, 1):
            after = now - timedelta(hours=hours, minutes=7)
            assert kept.due("a", after, now, 1000) == schedules.Runs(expression).due("a", after, now, 1000)


@pytest.mark.parametrize("zone", ["Europe/Paris", "America/Havana", "Pacific/Apia", "UTC"])
def test_drawn_runs_of_many_schedules_at_once(zone):
    """As stepped through one by one; only days on which the clocks change about midnight are left to that."""
    rng = random.Random(zone)
    for now in (datetime(2011, 12, 31, 5), datetime(2024, 4, 2, 21, 30), datetime(2024, 11, 4, 0, 0, 1)):
        for span, limit in (("22:00-23:30", 1000), ("00:00-23:59", 1000), ("02:00-04:00", 3)):
            runs = schedules.Runs(f"@between {span} {zone} random")
            when = lambda: now + timedelta(seconds=rng.randrange(-86400 * 9, 86400 * 2), microseconds=rng.randrange(10**6))  # noqa: E731, B023
            keys = [f"s-{rng.randrange(10**6)}" + "é" * (i % 3) for i in range(200)]
            cursor = [when() if i % 3 == 0 else None for i in range(200)]
            seed = [c or when() for c in cursor]
            micros = [np.array(v, "datetime64[us]").astype(np.int64) for v in (cursor, seed)]
            got = {}
            for of, n, found, following in schedules.window_runs(runs.window, keys, *micros, now, limit):
                parts = np.split(found.astype("datetime64[us]"), np.cumsum(n)[:-1])
                got |= {i: (p.tolist(), f) for i, p, f in zip(of.tolist(), parts, following.astype("datetime64[us]").tolist(), strict=True)}
            want = {}
            for i in range(200):
                try:
                    want[i] = schedules.cursor_runs(runs, keys[i], cursor[i], seed[i], now, limit)
                except ValueError:
                    continue
            assert all(want[i] == x for i, x in got.items()) and (len(got) == len(want) or zone in ("America/Havana", "Pacific/Apia") or span == "00:00-23:59")


def hourly(spark, n):
    """n schedules of one expression in one task; seeds rise within five rows and start anew behind them."""
    s = spark.range(n).coalesce(1).select(F.concat(F.lit("s"), F.col("id")).alias("id"), F.lit("5 * * * *").alias("expression"), F.lit(False).alias("paused"), F.timestamp_add("HOUR", F.when(F.col("id") == 0, 0).otherwise(F.col("id") % 5 * 4 + 4).cast("int"), F.lit("2024-01-04 00:30:00").cast("timestamp")).cast("timestamp_ntz").alias("created_at"))
    none = F.lit(None).cast("timestamp_ntz")
    return s.withColumns({"last_run": none, "next_run": none, "catch_up_policy": F.lit("queue")})


def test_catch_up_over_several_batches(small_batches):
    s = hourly(small_batches, 20)
    runs = schedules.due(s, datetime(2024, 1, 5)).where("due_at is not null").join(s.select("id", "catch_up_policy"), "id")
    found = {r.id: r.n for r in schedules.catch_up(runs, "2024-01-05 00:00:00").groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert found == {f"s{i}": 23 - (i % 5 * 4 + 4 if i else 0) for i in range(20)}


def test_enqueue_joins_nothing(spark, sf):
    plan = queries.QUERIES["t7_enqueue"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "Broadcast" not in plan


def test_due_is_spread_however_few_files_hold_schedules(spark):
    due = schedules.due(hourly(spark, 20), datetime(2024, 1, 5))
    assert due.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_backup_run_counts_a_targets_chunks_once(spark, monkeypatch):
    """Thirty requests of a target: one manifest is looked up, and references are those of all."""
    asked = []
    whole = backup.uploaded
    monkeypatch.setattr(backup, "uploaded", lambda refs, *a: (asked.append(refs.count()), whole(refs, *a))[1])
    requests = spark.range(30).select(F.format_string("%02d", "id").alias("id"), F.concat(F.lit("t"), F.col("id") % 2).alias("target_id"), F.lit("s").alias("storage_id"), F.lit("full").alias("type"))
    streams = spark.createDataFrame([("t0", "a", b"one"), ("t0", "b", b"two"), ("t0", "c", b"one"), ("t1", "a", b"two"), ("t2", "a", b"three")], "target_id string, name string, data binary")
    none = spark.createDataFrame([], "id string, target_id string, storage_id string, type string, ended_at timestamp_ntz, manifest_id string")
    manifests, refs, objects = backup.run(requests, streams, none, spark.createDataFrame([], "object_key string"), F.lit(b"0123456789abcdef"), F.lit("k"), F.lit("none"))
    got = {r.manifest_id: (r.chunks, r.bytes_in, r.uploaded_chunks) for r in manifests.collect()}
    assert got == {f"m-{i:02d}": (1, 3, 0) if i % 2 else (3, 9, 0 if i else 2) for i in range(30)}
    assert asked == [4] and objects.count() == 2
    rows = refs.collect()
    assert sorted((r.manifest_id, r.sequence) for r in rows) == sorted((f"m-{i:02d}", n) for i in range(30) for n in range(1 if i % 2 else 3))
    assert sorted((r.manifest_id, r.sequence) for r in rows if not r.duplicate) == [("m-00", 0), ("m-00", 1)] and all((r.stored_size > 0) != r.duplicate for r in rows)


def test_a_log_is_numbered_in_many_tasks(spark, sf):
    plan = fixtures.load(spark, sf, "audit_events")._jdf.queryExecution().optimizedPlan().toString()
    assert re.findall(r"row_number\(\) windowspecdefinition\((\w+?)#", plan) == ["__minute"] or "row_number() windowspecdefinition(date_trunc" in plan or "row_number() windowspecdefinition(_w" in plan
    events = spark.createDataFrame([(i, f"2024-01-0{i % 3 + 1} 00:0{i % 2}:0{i % 4 // 2}") for i in range(50)] + [(99, None)], "event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = [r.event_id for r in sorted(fixtures.numbered(events).collect(), key=lambda r: r["__number"])]
    assert got == [r.event_id for r in events.orderBy("ts", "event_id").collect()] and sorted(r["__number"] for r in fixtures.numbered(events).collect()) == list(range(1, 52))


def test_a_long_chain_is_handed_on_from_range_to_range(spark, sf):
    log = fixtures.load(spark, sf, "audit_events")
    log = log.where("seq % 7 <> 3 and (seq < 300 or seq > 600)")
    whole, handed = integrity.chained(log), integrity.chained(log, at_once=100)
    assert sorted(map(str, whole.collect())) == sorted(map(str, handed.collect()))
    plan = handed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") >= 5 and "MapInArrow" not in plan


def test_duplicates_by_hash_are_counted_without_a_join(spark):
    refs = spark.createDataFrame([("m1", 0, "a"), ("m1", 0, "a"), ("m1", 1, "a"), ("m0", 5, "a"), ("m1", 2, "b"), ("m2", 0, None)], "manifest_id string, sequence long, hash string")
    counted = integrity.dedup_counts(refs)
    assert {tuple(r) for r in counted.collect()} == {("a", 3, 2), ("b", 1, 0), (None, 1, 0)}
    assert "Join" not in counted._jdf.queryExecution().optimizedPlan().toString()


def test_garbage_totals_reads_objects_and_references_once(spark):
    h = ["%064x" % i for i in range(6)]
    key = lambda x: f"data/{x[:2]}/{x[2:4]}/{x}"
    objects = spark.createDataFrame([(key(h[0]), 5), (key(h[1]), 7), (key(h[2]), 11), ("data/zz", 13), ("tmp/x", 17), (key("AB" * 32), 19)], "object_key string, size long")
    refs = spark.createDataFrame([(h[0],), (h[0],), (h[5],), ("",), (None,), ("ab" * 32,)], "hash string")
    totals = integrity.garbage_totals(objects, refs)
    assert tuple(totals.first()) == (5, 3, 4, 50)
    assert totals._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2
    assert tuple(integrity.garbage_totals(objects.where("false"), refs.where("false")).first()) == (0, 0, 0, 0)


def tangled(spark):
    """Chains that end, lack a parent, or lead into a cycle; one of 40 steps."""
    pairs = [("r", None), ("a", "r"), ("b", "a"), ("c", "a"), ("lost", "gone"), ("d", "lost"), ("x", "y"), ("y", "x"), ("z", "x"), ("k0", None)] + [(f"k{i}", f"k{i - 1}") for i in range(1, 40)]
    return pairs, spark.createDataFrame([(i, "incr", p, f"m-{i}") for i, p in pairs], "id string, type string, parent_id string, manifest_id string")


def test_restore_plans_read_backups_once_and_sort_no_steps(spark):
    pairs, backups = tangled(spark)
    whole = [(i, p) for i, p in pairs if i not in "xyz"]
    plan = lineage.restore_plans(backups.where("id not in ('x', 'y', 'z')"), backups.selectExpr("id as backup_id").where("backup_id not in ('x', 'y', 'z')"))
    up, want = dict(whole), []
    for i, _ in whole:
        path, at = [], i
        while at in up:
            path, at = [at, *path], up[at]
        want += [(i, n, x, "missing_parent" if at else "") for n, x in enumerate(path, 1)]
    assert sorted((r.backup_id, r.step_no, r.id, r.problem) for r in plan.collect()) == sorted(want)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in text
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    once = backups.mapInArrow(counted, backups.schema)
    lineage.restore_plans(once, backups.selectExpr("id as backup_id")).collect()
    assert calls.value == len(pairs)


def test_chain_totals_hold_a_row_for_each_backup(spark):
    pairs, backups = tangled(spark)
    refs = spark.createDataFrame([(f"m-{i}", n, None if i == "a" else n + 1) for i, _ in pairs if i not in ("r", "k3") for n in range(2)], "manifest_id string, sequence long, size long")
    wanted = backups.selectExpr("id as backup_id").unionByName(spark.createDataFrame([("none",)], "backup_id string"))
    steps = lineage.chain_refs(lineage.restore_plans(backups, wanted), refs)
    want = steps.groupBy("backup_id").agg(F.count("*").alias("chunks"), F.sum("size").alias("bytes"), F.countDistinct("step_no").alias("steps")).collect()
    got = lineage.chain_totals(backups, wanted, refs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) == 43
    assert got.columns == ["backup_id", "chunks", "bytes", "steps"]
    assert lineage.chain_totals(backups.where("parent_id is null"), wanted.where("backup_id = 'k0'"), refs).collect()[0][1:] == (2, 3, 1)


def given_to_arrow(monkeypatch, df, make):
    """What an operator runs on Arrow batches."""
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: f)
    return make(df)


def test_statements_of_a_batch_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(statements, "BATCH_CHARS", 1000)
    script = "select 1;" + "-" * 200 + "\nselect 2;"
    batch = pa.RecordBatch.from_pydict({"key": [str(i) for i in range(100)], "text": [None if i == 7 else "select '" if i == 8 else script for i in range(100)]})
    work = given_to_arrow(monkeypatch, spark.createDataFrame([("a", "b")], "k string, t string"), lambda df: statements.statements(df, "k", "t"))
    out = list(work(iter([batch])))
    assert len(out) > 10 and max(b.num_rows for b in out) < 20
    rows = [tuple(r.values()) for r in pa.Table.from_batches(out).to_pylist()]
    assert rows == [r for i in range(100) for r in ([] if i == 7 else [("8", -1, None)] if i == 8 else [(str(i), 0, "select 1;"), (str(i), 1, "-" * 200 + "\nselect 2;")])]


def test_chunks_of_a_batch_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chunking, "BATCH_BYTES", 1000)
    data = [None if i == 7 else b"" if i == 8 else bytes((i * j) % 251 for j in range(300)) for i in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(100)]), pa.array(data, pa.binary())], names=["key", "data"])
    for algo in (None, "sha256"):
        work = given_to_arrow(monkeypatch, spark.createDataFrame([("a", b"b")], "k string, d binary"), lambda df, algo=algo: chunking.chunks(df, "k", "d", 16, 64, 128, algo))
        out = list(work(iter([batch])))
        assert len(out) > 10
        rows = pa.Table.from_batches(out).to_pylist()
        assert [(r["key"], r["offset"], r["size"]) for r in rows] == [(str(i), a, b - a) for i, d in enumerate(data) if d for a, b in itertools.pairwise([0, *chunking.cuts(d, 16, 64, 128)])]
        assert algo or b"".join(r["data"] for r in rows) == b"".join(d or b"" for d in data)


def test_staged_objects_are_synced_together(tmp_path, monkeypatch):
    calls, whole = [], os.fsync
    monkeypatch.setattr(os, "fsync", lambda f: (calls.append(f), whole(f))[1])
    batch = pa.RecordBatch.from_pydict({"object_key": [f"a/{i}" for i in range(50)], "content": [b"x"] * 50})
    listed = objects.Stage({"path": str(tmp_path), "job": "j"}).write(iter([batch]))
    assert listed.objects == 50 and len(calls) < 5 and len(list(tmp_path.rglob("*.tmp"))) == 50
