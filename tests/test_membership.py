"""Blocked Bloom filter, positions of sources, the log in segments, figures of duplicates."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from granary.functions.positions import position_key, with_keys
from granary.operators import integrity, replay
from tests.test_objects import shuffled


def hashes(spark, start, end):
    return spark.range(start, end, 1, 4).selectExpr("sha2(concat('x', id), 256) as hash", "id")


def test_blocked_filter(spark):
    """No false negative; false positives as the theory of blocks says (load of a block is Poisson)."""
    entries = hashes(spark, 0, 20_000)
    got = integrity.membership(hashes(spark, 0, 80_000), entries).collect()
    assert len(got) == 80_000 and all(r.maybe and r.present for r in got if r.id < 20_000) and not any(r.present for r in got if r.id >= 20_000)
    rate = sum(r.maybe for r in got if r.id >= 20_000) / 60_000
    assert 0.005 < rate < 0.02  # theory: 0.0082 without blocks, about 0.011 with blocks of 512 bits
    assert integrity.membership(hashes(spark, 0, 50), entries.limit(0)).where("maybe or present").count() == 0
    odd = integrity.membership(spark.createDataFrame([(None, 1), (None, 2)], "hash string, id long"), entries).collect()
    assert [(r.maybe, r.present) for r in odd] == [(False, False)] * 2
    twice = hashes(spark, 0, 10).union(hashes(spark, 0, 10))
    assert integrity.membership(twice, twice).where("present").count() == 20


def test_misses_are_not_exchanged(spark, monkeypatch):
    entries, lookups = hashes(spark, 0, 2000).cache(), hashes(spark, 1000, 101_000)
    run = lambda: integrity.membership(lookups, entries).write.format("noop").mode("overwrite").save()
    exact = lambda: lookups.join(entries.select("hash", F.lit(True).alias("present")).hint("shuffle_hash"), "hash", "left").write.format("noop").mode("overwrite").save()
    assert shuffled(spark, run) < shuffled(spark, exact) / 5
    monkeypatch.setattr(integrity, "BROADCAST_BLOCKS", 0)  # a filter too large to broadcast gives the same
    assert integrity.membership(lookups, entries).where("present").count() == 1000
    entries.unpersist()


# positions


def ordered(spark, kind, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "p string").select("p", position_key(kind, F.col("p")).alias("k")).collect()
    return [r.p for r in sorted(rows, key=lambda r: r.k)]


def test_position_keys_keep_the_order(spark):
    r = random.Random(1)
    lsn = [f"{hi:X}/{lo:X}" for hi, lo in sorted({(r.choice([0, 1, 0xF, 0x10, 0xFFFFFFFF]), r.choice([0, 9, 0xA, 0x10, 0x9FFFFFFF, 0xA0000000])) for _ in range(40)})]
    binlog = [f"mysql-bin.{f:06d}:{o}" for f, o in sorted({(r.choice([9, 10, 999_999, 1_000_000]), r.choice([4, 10, 99, 2**40])) for _ in range(40)})]
    oplog = [f"Timestamp({s}, {n})" if i % 2 else f"{s}:{n}" for i, (s, n) in enumerate(sorted({(r.choice([999_999_999, 1_700_000_000, 4_294_967_295]), r.choice([1, 9, 10, 100])) for _ in range(40)}))]
    token = sorted({r.randbytes(r.choice([4, 5, 9])).hex() for _ in range(40)})
    offset = [str(n) if n % 2 else f"8371b4fb:{n}" for n in sorted({r.choice([9, 10, 11, 99, 100, 10**19 - 1, n]) for n in range(40)})]
    for kind, want in (("lsn", lsn), ("binlog", binlog), ("oplog", oplog), ("token", token), ("offset", offset)):
        shuffled_ = want[:]
        r.shuffle(shuffled_)
        assert ordered(spark, kind, shuffled_) == want
    bad = {"lsn": ["", "16", "G/1", "1/123456789", None], "binlog": ["bin:4", "bin.x:4", "bin.1"], "oplog": ["now", "1:2:3"], "token": ["abc", "zz"], "offset": ["-1", "x:1", "1.5"]}
    for kind, texts in bad.items():
        good, wrong = with_keys(spark.createDataFrame([(t,) for t in texts], "position string"), kind)
        assert good.count() == 0 and wrong.count() == len(texts)
    with pytest.raises(ValueError):
        position_key("wal", F.lit("1"))


def test_ranges_of_keys_push_down(spark, tmp_path):
    log, _ = with_keys(spark.range(1000).select("id", F.format_string("%x/%X", F.floor(F.col("id") / 16), F.col("id") % 16).alias("position")), "lsn")
    log.write.parquet(f"{tmp_path}/log")
    after = spark.range(1).select(position_key("lsn", F.lit("2/F"))).first()[0]
    found = spark.read.parquet(f"{tmp_path}/log").where(F.col("position_key") > after)
    assert "PushedFilters: [IsNotNull(position_key), GreaterThan(position_key," in found._jdf.queryExecution().toString()
    assert found.count() == 1000 - 48
    points = replay.resume_points(found.where("id < 500").withColumn("s", F.lit(1)), ["s"], "position_key")
    assert replay.resumed(log.withColumn("s", F.lit(1)), points, ["s"], "position_key").count() == 500


# the log in segments


def test_segments_of_the_log(spark):
    n, size = 1050, 100
    events = spark.range(1, n + 1).selectExpr("id as seq", "concat('e', id) as id", "'u' as actor_id", "'a' as action", "'r' as resource_type", "cast(null as string) as resource_id", "'{}' as metadata_json", "timestamp_ntz '2024-01-01 00:00:00' as occurred_at")
    chains, heads = integrity.chained_segments(events.repartition(5), size)
    rows, tops = chains.orderBy("seq").collect(), heads.orderBy("segment").collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    last = ""
    for r in rows:
        last = sha(f"segment|{r.segment}") if r.seq % size == 1 else last
        assert r.segment == (r.seq - 1) // size and r.prev_hash == last
        last = sha(f"{r.seq}|{r.id}|u|a|r||{{}}|1704067200000000|{last}")
        assert r.hash == last
    last = ""
    for h in tops:
        end = min(n, size * (h.segment + 1))
        assert (h.first_seq, h.last_seq, h.digest, h.prev_head) == (size * h.segment + 1, end, rows[end - 1].hash, last)
        last = sha(f"{h.segment}|{h.first_seq}|{h.last_seq}|{h.digest}|{last}")
        assert h.head == last
    whole, headed = spark.createDataFrame(rows, chains.schema), spark.createDataFrame(tops, heads.schema)
    bad = lambda e, h: {tuple(r) for r in integrity.segment_violations(e, h, size).collect()}
    assert bad(whole, headed) == set()
    assert bad(whole.where("seq <> 150"), headed) == {(1, 151, "gap")}
    assert bad(whole.where("seq <> 200"), headed) == {(1, None, "end")}  # the last of a segment
    assert bad(whole.where("segment <> 4"), headed) == {(4, None, "no events")}
    assert bad(whole, headed.where("segment <> 4")) == {(4, None, "no head"), (5, None, "gap")}
    assert bad(whole.withColumn("actor_id", F.when(F.col("seq") == 300, "x").otherwise(F.col("actor_id"))), headed) == {(2, 300, "digest")}
    # a segment that is made anew as a whole shows in its head, and heads made anew in the next
    changed = events.withColumn("actor_id", F.when(F.floor((F.col("seq") - 1) / size) == 3, "x").otherwise(F.col("actor_id")))
    again, other = integrity.chained_segments(changed, size)
    forged = whole.where("segment <> 3").unionByName(again.where("segment = 3"))
    assert bad(forged, headed) == {(3, None, "end")}
    assert bad(forged, headed.where("segment <> 3").unionByName(other.where("segment = 3"))) == {(4, None, "link")}
    assert integrity.chained_segments(events.limit(0), size)[1].count() == 0
    with pytest.raises(ValueError):
        integrity.chained_segments(events, 0)


def test_dedup_totals(spark):
    r = random.Random(4)
    refs = [(f"m{r.randrange(6)}", r.randrange(20), f"h{r.randrange(9)}", r.randrange(1, 5)) for _ in range(150)] + [("n", 0, None, 7)]
    df = spark.createDataFrame(refs, "manifest_id string, sequence long, hash string, size long")
    first = {}
    for m, s, h, z in sorted(refs, key=lambda x: (x[0], x[1], x[3])):
        first.setdefault(h, (m, z))
    for row in integrity.dedup_totals(df).collect():
        own = [x for x in refs if x[0] == row.manifest_id]
        up = [z for m, z in first.values() if m == row.manifest_id]
        assert (row.chunks, row.bytes_in, row.uploaded_chunks, row.bytes_uploaded, row.deduped_chunks) == (len(own), sum(x[3] for x in own), len(up), sum(up), len(own) - len(up))
    assert integrity.dedup_totals(df.limit(0)).collect() == []


def test_orphans_are_not_exchanged(spark, monkeypatch):
    key = integrity.object_key(F.col("hash"))
    objects, refs = hashes(spark, 1000, 101_000).select(key.alias("object_key"), F.col("id").alias("size")).cache(), hashes(spark, 0, 2000)
    objects.count()
    run = lambda: integrity.orphans(objects, refs).write.format("noop").mode("overwrite").save()
    exact = lambda: objects.join(refs.select(key.alias("object_key")).hint("merge"), "object_key", "left_anti").write.format("noop").mode("overwrite").save()
    assert shuffled(spark, run) < shuffled(spark, exact) / 5
    assert integrity.orphans(objects, refs).count() == 99_000
    odd = spark.createDataFrame([("data/x", 1), ("data/AB/CD/ABCD", 2), ("tmp/x", 3), (None, 4), ("data/ab/cd/abcd", 5)], "object_key string, size long")
    marks = spark.createDataFrame([("ABCD",), ("abcd",), (None,), ("abcd",)], "hash string")
    for blocks in (integrity.BROADCAST_BLOCKS, 0):
        monkeypatch.setattr(integrity, "BROADCAST_BLOCKS", blocks)
        assert [tuple(r) for r in integrity.orphans(odd, marks).collect()] == [("data/x", 1)]
    assert integrity.orphans(odd, marks.limit(0)).count() == 3
    objects.unpersist()


def test_references_of_few_manifests_are_not_exchanged(spark, monkeypatch):
    refs = spark.range(1000).selectExpr("concat('m', id % 10) as manifest_id", "concat('h', id % 4) as hash")
    some = spark.createDataFrame([("m1",), ("m2",), ("m2",), (None,)], "manifest_id string")
    plan = lambda: integrity.held_refs(refs, some)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan() and integrity.held_refs(refs, some).count() == 200
    monkeypatch.setattr(integrity, "BROADCAST_MANIFESTS", 1)
    assert "BroadcastHashJoin" not in plan() and integrity.held_refs(refs, some).count() == 200


def test_distinct_hashes_keep_every_text(spark):
    texts = ["ab" * 32, "AB" * 32, "ab" * 31, "", None, "\1x", "é" * 64, "ab" * 32]
    got = integrity.distinct_hashes(spark.createDataFrame([(t,) for t in texts], "hash string")).collect()
    assert sorted((r.hash for r in got), key=str) == sorted(set(texts), key=str)
