"""Known cases of the service's operators, and the registered queries against their SQL."""

from __future__ import annotations

from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from granary import queries
from granary.functions import chunking, cron, durations, statements
from granary.operators import admission, catalog, integrity, jobs, lineage, metrics, replay, retention, schedules
from granary.sources import stores

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NOW = "2026-04-25 12:00:00"


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(rows):
    cell = lambda x: x.isoformat() if hasattr(x, "isoformat") else round(x, 6) if isinstance(x, float) else x
    return sorted([tuple(map(cell, r)) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, sf, con, name):
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    cur = con.execute(queries.SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in cur.fetchall()]
    assert plain(df.select(*[f"`{c}`" for c in columns]).collect()) == plain(want)


def test_every_query_runs(spark, sf):
    for name in set(queries.QUERIES) - set(queries.SQL):
        queries.QUERIES[name](spark, sf).collect()


# retention


def backups(spark, rows):
    df = spark.createDataFrame(rows, "id string, type string, ended_at string, size_bytes long, protected boolean, parent_id string")
    return df.withColumn("ended_at", F.col("ended_at").cast("timestamp_ntz")).withColumn("started_at", F.col("ended_at"))


def resolved(spark, rows, rules):
    return {r.id: r.reasons for r in retention.resolve(backups(spark, rows), rules, NOW).collect()}


def test_count_by_type(spark):
    rows = [("full-old", "full", "2026-04-25 08:00:00", 1, False, None), ("full-mid", "full", "2026-04-25 09:00:00", 1, False, None), ("full-new", "full", "2026-04-25 10:00:00", 1, False, None), ("incr-new", "incr", "2026-04-25 11:00:00", 1, False, None)]
    got = resolved(spark, rows, [{"kind": "count", "params": {"n": 2, "type": "full"}}])
    assert got == {"full-new": "count", "full-mid": "count", "full-old": "", "incr-new": ""}


def test_time_and_protected(spark):
    rows = [("new", "full", "2026-04-25 11:30:00", 1, False, None), ("edge", "full", "2026-04-24 12:00:00", 1, False, None), ("old", "full", "2026-04-22 12:00:00", 1, False, None), ("hold", "full", "2026-03-26 12:00:00", 1, True, None)]
    assert resolved(spark, rows, [{"kind": "time", "params": {"duration": "24h"}}]) == {"new": "time", "edge": "time", "old": "", "hold": "protected"}


def test_size_skips_what_does_not_fit(spark):
    rows = [("new", "full", "2026-04-25 11:00:00", 70, False, None), ("mid", "full", "2026-04-25 10:00:00", 40, False, None), ("old", "full", "2026-04-25 09:00:00", 10, False, None), ("held", "full", "2026-04-25 11:30:00", 500, True, None)]
    assert resolved(spark, rows, [{"kind": "size", "params": {"max_bytes": 80}}]) == {"new": "size", "mid": "", "old": "size", "held": "protected"}


def test_gfs(spark):
    days = ["2026-04-25", "2026-04-24", "2026-04-23", "2026-04-18", "2026-03-20", "2025-12-20"]
    rows = [(d, "full", f"{d} 02:00:00", 1, False, None) for d in days]
    got = resolved(spark, rows, [{"kind": "gfs", "params": {"daily": 2, "weekly": "2", "monthly": 2.0, "yearly": 2}}])
    assert [d for d in days if not got[d]] == ["2026-04-23"]
    assert got["2026-04-25"] == "gfs:daily,gfs:weekly,gfs:monthly,gfs:yearly"


def test_reasons_once_in_policy_order(spark):
    rows = [("new", "full", "2026-04-25 11:00:00", 1, False, None), ("mid", "full", "2026-04-23 12:00:00", 1, False, None), ("old", "full", "2026-04-21 12:00:00", 1, False, None)]
    rules = [{"kind": "count", "params": {"n": 1}}, {"kind": "time", "params": {"duration": "72h"}}, {"kind": "count", "params": {"n": 1}}]
    assert resolved(spark, rows, rules) == {"new": "count,time", "mid": "time", "old": ""}


def test_chain_keeps_ancestors(spark):
    rows = [("lone", "full", "2026-04-25 08:00:00", 1, False, None), ("full", "full", "2026-04-25 09:00:00", 1, False, None), ("i1", "incr", "2026-04-25 10:00:00", 1, False, "full"), ("i2", "incr", "2026-04-25 11:00:00", 1, False, "i1"), ("lost", "incr", "2026-04-24 10:00:00", 1, False, "gone")]
    assert resolved(spark, rows, [{"kind": "count", "params": {"n": 1}}]) == {"lone": "", "full": "chain", "i1": "chain", "i2": "count", "lost": ""}


def test_long_chains_and_cycles_end(spark):
    rows = [(f"b{i}", "incr", "2026-04-01 00:00:00", 1, i == 300, f"b{i - 1}" if i else None) for i in range(301)]
    assert all(resolved(spark, rows, []).values())
    rows = [("a", "incr", "2026-04-01 00:00:00", 1, True, "b"), ("b", "incr", "2026-04-01 00:00:00", 1, False, "a")]
    assert resolved(spark, rows, []) == {"a": "protected", "b": "chain"}


def test_bad_rules(spark):
    rows = [("a", "full", "2026-04-25 08:00:00", 1, False, None)]
    for rule in ({"kind": "mystery"}, {"kind": "count", "params": {"n": -1}}, {"kind": "count"}, {"kind": "time", "params": {"duration": "-1h"}}):
        with pytest.raises(ValueError):
            resolved(spark, rows, [rule])


# restore plans, parents


def chain(spark, pairs):
    return spark.createDataFrame([(i, "incr" if p else "full", p, f"m-{i}") for i, p in pairs], "id string, type string, parent_id string, manifest_id string")


def plans(spark, pairs, *wanted):
    got = lineage.restore_plans(chain(spark, pairs), spark.createDataFrame([(w,) for w in wanted], "backup_id string")).orderBy("backup_id", "step_no").collect()
    return [(r.backup_id, r.step_no, r.id, r.problem) for r in got]


def test_restore_plan_root_first(spark):
    assert plans(spark, [("full", None), ("i1", "full"), ("i2", "i1")], "i2") == [("i2", 1, "full", ""), ("i2", 2, "i1", ""), ("i2", 3, "i2", "")]


def test_restore_plan_problems(spark):
    got = plans(spark, [("a", "b"), ("b", "a"), ("c", "gone")], "a", "c", "nothing")
    assert {(b, p) for b, _, _, p in got} == {("a", "cycle"), ("c", "missing_parent"), ("nothing", "missing")}


def test_restore_plan_of_a_long_chain(spark):
    pairs = [("b0", None), *[(f"b{i}", f"b{i - 1}") for i in range(1, 131)]]
    got = plans(spark, pairs, "b130", "b96")
    assert got == sorted([(w, i + 1, f"b{i}", "") for w, n in (("b130", 131), ("b96", 97)) for i in range(n)])
    loop = plans(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b")], "a", "c")
    assert loop == [("a", 1, "d", "cycle"), ("a", 2, "c", "cycle"), ("a", 3, "b", "cycle"), ("a", 4, "a", "cycle"), ("c", 1, "b", "cycle"), ("c", 2, "d", "cycle"), ("c", 3, "c", "cycle")]


def test_parents(spark):
    rows = [("f1", "full", "2026-04-01 00:00:00"), ("i1", "incr", "2026-04-02 00:00:00"), ("i2", "incr", "2026-04-09 00:00:00")]
    b = spark.createDataFrame([(i, "t", "s", k, "m", e) for i, k, e in rows], "id string, target_id string, storage_id string, type string, manifest_id string, ended_at string").withColumn("ended_at", F.col("ended_at").cast("timestamp_ntz"))
    due = spark.createDataFrame([("x", "t", "s", "incr"), ("y", "t", "s", "diff"), ("z", "other", "s", "incr"), ("w", "t", "s", "full")], "id string, target_id string, storage_id string, type string")
    got = {r.id: (r.type, r.parent_id) for r in lineage.attach_parents(due, b).collect()}
    assert got == {"x": ("incr", "i2"), "y": ("diff", "f1"), "z": ("full", None), "w": ("full", None)}
    due = due.withColumn("due_at", F.lit("2026-04-03 00:00:00").cast("timestamp_ntz"))
    assert {r.id: r.parent_id for r in lineage.attach_parents(due, b, as_of=True).collect()}["x"] == "i1"


# admission and jobs


def job_rows(spark, rows):
    df = spark.createDataFrame(rows, "id string, status string, target_id string, agent_id string, queued_at string")
    return df.withColumn("queued_at", F.col("queued_at").cast("timestamp_ntz")).withColumn("error", F.lit(""))


def test_claim(spark):
    js = job_rows(spark, [("r", "running", "t1", "a1", "2026-04-25 09:00:00"), ("q1", "queued", "t1", "", "2026-04-25 09:30:00"), ("q2", "queued", "t2", "", "2026-04-25 10:00:00"), ("q3", "queued", "t3", "", "2026-04-25 10:00:00")])
    targets = spark.createDataFrame([("t2", " a9 "), ("t3", "")], "id string, agent_label string")
    agents = lambda *rows: spark.createDataFrame(list(rows), "agent_id string, capacity int, status string")
    claim = lambda a, who: [r.id for r in admission.claim(js, targets, a, who, NOW).collect()]
    assert claim(agents(("a1", 2, "healthy")), "a1") == ["q3"]
    assert claim(agents(("a1", 2, "healthy")), "a9") == ["q2"]
    assert claim(agents(("a1", 0, "healthy")), "a1") == []  # no room
    assert claim(agents(("a1", 1, "degraded")), "a1") == ["q1"]  # the lost job frees its target
    assert [r.id for r in admission.ready(js).orderBy("id").collect()] == ["q2", "q3"]


def test_job_moves(spark):
    js = job_rows(spark, [("a", "queued", "t", "", "2026-04-25 09:00:00"), ("b", "succeeded", "t", "", "2026-04-25 09:00:00"), ("c", "failed", "t", "x", "2026-04-25 09:00:00")])
    asked = js.select("id")
    state = lambda df: {r.id: r.status for r in df.collect()}
    assert state(jobs.start(js, asked.withColumn("on_agent", F.lit("a1")), NOW)) == {"a": "running", "b": "succeeded", "c": "failed"}
    assert state(jobs.finish(js, asked.withColumn("final", F.lit("canceled")).withColumn("message", F.lit("")), NOW)) == {"a": "canceled", "b": "succeeded", "c": "failed"}
    assert state(jobs.retry(js, asked, NOW)) == {"a": "queued", "b": "succeeded", "c": "queued"}
    more = asked.union(spark.createDataFrame([("d",)], "id string"))
    assert {r.id: r.problem for r in jobs.illegal(js, more, "start").collect()} == {"b": "is_succeeded", "c": "is_failed", "d": "not_found"}


# schedules


@pytest.mark.parametrize(
    ("text", "after", "next_"),
    [
        ("0 * * * *", "2026-04-25T10:00:00", "2026-04-25T11:00:00"),
        ("*/15 9-17 * * mon-fri", "2026-04-24T17:45:00", "2026-04-27T09:00:00"),
        ("30 5 4 * * *", "2026-04-25T04:05:30", "2026-04-26T04:05:30"),
        ("0 0 13 * fri", "2026-04-25T00:00:00", "2026-05-01T00:00:00"),  # both days restricted: either
        ("0 0 29 feb *", "2026-04-25T00:00:00", "2028-02-29T00:00:00"),
        ("@weekly", "2026-04-25T00:00:00", "2026-04-26T00:00:00"),
        ("0 0 * * 7", "2026-04-25T00:00:00", "2026-04-26T00:00:00"),
    ],
)
def test_cron_next(text, after, next_):
    assert cron.next_run(cron.parse(text), datetime.fromisoformat(after)) == datetime.fromisoformat(next_)


@pytest.mark.parametrize("text", ["", "* * *", "60 * * * *", "*/0 * * * *", "5-1 * * * *", "a * * * *"])
def test_cron_errors(text):
    with pytest.raises(ValueError):
        cron.parse(text)


def test_windows():
    w = cron.parse_window("@between 02:00-04:00 Europe/Paris random")
    a, b = cron.next_window(w, datetime(2026, 1, 1), "k"), cron.next_window(w, datetime(2026, 1, 1), "k")
    assert a == b and datetime(2026, 1, 1, 1) <= a < datetime(2026, 1, 1, 3)
    assert cron.next_window(cron.parse_window("@between 02:00-04:00"), datetime(2026, 1, 1, 2), "k") == datetime(2026, 1, 2, 2)
    for bad in ("@between 04:00-02:00", "@between 24:00-25:00", "between 1:00-2:00"):
        with pytest.raises(ValueError):
            cron.parse_window(bad)


def states(spark, rows):
    df = spark.createDataFrame(rows, "id string, expression string, paused boolean, created_at string, catch_up_policy string")
    none = F.lit(None).cast("timestamp_ntz")
    return df.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")).withColumn("last_run", none).withColumn("next_run", none)


def test_tick_and_catch_up(spark):
    at = "2026-04-25 10:00:00"
    s = states(spark, [("q", "0 * * * *", False, at, "queue"), ("o", "0 * * * *", False, at, "run_once"), ("s", "0 * * * *", False, at, "skip"), ("p", "0 * * * *", True, at, "queue"), ("w", "@between 11:00-12:00 UTC", False, at, "queue"), ("bad", "x", False, at, "queue"), ("many", "* * * * * *", False, at, "queue")])
    runs = schedules.due(s, datetime(2026, 4, 25, 13), limit=3)
    problems = {r.id for r in runs.where("problem is not null").collect()}
    assert problems == {"bad", "many"}
    due = schedules.catch_up(runs.where("due_at is not null").join(s.select("id", "catch_up_policy"), "id"), "2026-04-25 13:00:00")
    found = {}
    for r in due.collect():
        found.setdefault(r.id, []).append(r.due_at.hour)
    assert {k: sorted(v) for k, v in found.items()} == {"q": [11, 12, 13], "o": [13], "s": [13], "w": [11]}


def test_durations():
    assert [durations.seconds_of(x) for x in ("7d", "1.5w", "1h30m", "250ms", 5, "0")] == [604800, 907200, 5400, 0.25, 5, 0]
    for bad in ("-1h", "1x", "", "d", "-2d"):
        with pytest.raises(ValueError):
            durations.seconds_of(bad)
    now = datetime(2026, 4, 25, 12)
    assert durations.time_bound("2026-04-25T10:00:00+02:00", now) == datetime(2026, 4, 25, 8)
    assert durations.time_bound("1d", now) == datetime(2026, 4, 24, 12)


# chunks and integrity


def test_chunk_cuts():
    import random

    data = random.Random(1).randbytes(512 << 10)
    ends = chunking.cuts(data, 4 << 10, 8 << 10, 32 << 10)
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert ends[-1] == len(data) and all(4 << 10 <= n <= 32 << 10 for n in sizes[:-1]) and len(sizes) > 10
    table, mask = chunking.TABLE, (8 << 10) - 1

    def slow(d, low, average, high):
        out, at = [], 0
        while at < len(d):
            n = min(len(d) - at, high)
            size = n
            if len(d) - at > low:
                h = 0
                for i in range(low, n):
                    h = (h << 1) + int(table[d[at + i]]) & 2**64 - 1
                    if i >= average // 2 and h & mask == 0:
                        size = i + 1
                        break
            else:
                size = len(d) - at
            at += size
            out.append(at)
        return out

    assert ends == slow(data, 4 << 10, 8 << 10, 32 << 10)
    moved = b"xyz" + data  # most chunks are found again after an insertion

    def pieces(d):
        e = chunking.cuts(d, 4 << 10, 8 << 10, 32 << 10)
        return {d[a:b] for a, b in zip([0, *e], e, strict=False)}

    assert len(pieces(data) & pieces(moved)) > 0.8 * len(ends)
    assert chunking.cuts(b"", 1, 2, 4) == [] and chunking.cuts(b"abcabcabcabcabcabc", 4, 8, 16)[-1] == 18
    with pytest.raises(ValueError):
        chunking.cuts(b"x", 8, 4, 16)


def test_envelope_is_tamper_proof(spark):
    df = spark.createDataFrame([(bytearray(b"hello"),)], "data binary")
    key, digest = F.lit(b"0123456789abcdef"), F.lit(b"d")
    df = df.withColumn("e", chunking.sealed(F.col("data"), key, F.lit("k1"), F.lit(b"123456789012"), digest))
    assert bytes(df.select(chunking.opened(F.col("e"), key, digest).alias("x")).first().x) == b"hello"
    bad = df.withColumn("e", F.concat(F.expr("substring(e, 1, 5)"), F.unhex(F.lit("07")), F.expr("substring(e, 7)")))
    with pytest.raises(Exception):  # noqa: B017
        bad.select(chunking.opened(F.col("e"), key, digest)).collect()


def test_codecs(spark):
    df = spark.createDataFrame([(bytearray(b"a" * 1000), a) for a in ("none", "gzip", "zstd")] + [(None, "zstd")], "data binary, a string")
    back = df.select("data", "a", chunking.decompressed(chunking.compressed("data", "a"), F.col("a")).alias("b")).collect()
    assert all(r.data == r.b for r in back)


def test_entropy(spark):
    df = spark.createDataFrame([("x", bytearray(range(256))), ("y", bytearray(b"aaaa")), ("z", bytearray())], "k string, d binary")
    got = {r.key: round(r.entropy, 6) for r in metrics.entropy(df, "k", "d").collect()}
    assert got == {"x": 8.0, "y": 0.0, "z": 0.0}


def test_garbage_fails_closed(spark):
    objects = spark.createDataFrame([("data/aa/bb/aabb", 5), ("manifests/x", 1)], "object_key string, size long")
    refs = spark.createDataFrame([("m", 0, "ffff")], "manifest_id string, sequence int, hash string")
    assert [r.object_key for r in integrity.orphans(objects, refs).collect()] == ["data/aa/bb/aabb"]
    with pytest.raises(ValueError):
        integrity.garbage_totals(objects, refs, bad_manifests=1)


# filters, statements, stores


def test_scopes_and_ids(spark):
    df = spark.createDataFrame([("backup:*", "backup:read", True), ("*", "x", True), ("job:read", "job:write", False), ("", "x", False), ("x", "", True), ("admin:*", "y", True)], "s string, need string, ok boolean")
    assert all(r.got == r.ok for r in df.select("ok", catalog.allows(F.split("s", ","), F.col("need")).alias("got")).collect())
    ids = spark.createDataFrame([("a-b_c.d:e/f", True), (" a", False), ("", False), ("x" * 129, False), ("a\n", False)], "id string, ok boolean")
    assert all(r.got == r.ok for r in ids.select("ok", catalog.valid_id(F.col("id")).alias("got")).collect())
    with pytest.raises(ValueError):
        catalog.between(F.col("x"), "2026-01-02", "2026-01-01")


@pytest.mark.parametrize(
    ("dialect", "sql", "want"),
    [
        ("postgres", "select ';'; select \"a;\"\"b\"; -- x;\nselect $t$;$t$;", ["select ';';", 'select "a;""b";', "-- x;\nselect $t$;$t$;"]),
        ("postgres", "a /* ; */ b; c", ["a /* ; */ b;", "c"]),
        ("postgres", " ; ", []),
        ("mysql", "DELIMITER ;;\nselect ';' ; b", ["select ';'", "b"]),
        ("mongo", "a; // x;\nb; 'y;'", ["a", "b", "'y;'"]),
    ],
)
def test_split(dialect, sql, want):
    assert statements.split(sql, dialect) == want


@pytest.mark.parametrize("sql", ["select 'a", 'select "a', "select /* a", "select $x$ a $y$"])
def test_unterminated(sql):
    with pytest.raises(ValueError):
        statements.split(sql)


def test_manifests_and_objects(spark, tmp_path):
    folder = tmp_path / "manifests" / "2026"
    folder.mkdir(parents=True)
    (folder / "m.manifest").write_text('{"id":"m","version":1,"objects":[{"name":"db","chunks":[{"key":"k1","hash":"h1","size":3},{"key":"k2","hash":"h2","size":4}]}]}')
    (folder / "bad.manifest").write_text("nothing")
    (folder / "v.manifest").write_text('{"id":"v","version":9}')
    found = stores.read_manifests(spark, str(tmp_path))
    assert {r.id: r.problem for r in found.collect()} == {"m": None, None: "unreadable", "v": "version"}
    refs = stores.manifest_refs(found.where("problem is null")).collect()
    assert [(r.sequence, r.key) for r in refs] == [(0, "k1"), (1, "k2")]
    assert [r.object_key for r in stores.objects(spark, str(tmp_path), "manifests/").collect()] == ["manifests/2026/bad.manifest", "manifests/2026/m.manifest", "manifests/2026/v.manifest"]
    part = stores.object_bytes(spark, str(tmp_path), "manifests/2026/bad.manifest", 2, 3).first().content
    assert bytes(part) == b"thi"


def test_put_if_absent(spark, tmp_path):
    new = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "object_key string, size long")
    old = spark.createDataFrame([("a", 9)], "object_key string, size long")
    refused = stores.write_new_objects(new, old, str(tmp_path / "o"))
    assert [r.object_key for r in refused.collect()] == ["a"]
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "o")).collect()] == [("b", 2)]
    with pytest.raises(ValueError):
        stores.restorable(spark.createDataFrame([("database", False)], "kind string, done boolean"))


def test_rate_limit_window_is_anchored(spark):
    rows = [(1, 0), (2, 1), (3, 2), (4, 9), (5, 10), (6, 11), (7, 19), (8, 20)]
    df = spark.createDataFrame([("c", i, s) for i, s in rows], "client string, id long, s int").withColumn("at", F.lit("2026-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("s").cast("decimal(18,6)")))
    got = {r.id: r.allowed for r in replay.rate_limited(df, "client", "at", 10, 2, "id").collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True, 6: True, 7: False, 8: True}


def test_rendering(spark):
    from granary.sources import render

    df = render.union_of([spark.createDataFrame([("x", 1)], "name string, b int"), spark.createDataFrame([("y",)], "a string")])
    assert df.columns == ["a", "b", "name"]
    assert render.shown(df).split("\n")[0].split() == ["A", "B", "NAME"] and '"name": "x"' in render.shown(df, indent=True)


def test_readiness(spark):
    probes = spark.createDataFrame([(2, "jobs", "lost"), (1, "users", None), (3, "audit", "gone")], "place int, store string, error string")
    assert tuple(metrics.readiness(probes).first()) == (False, 2, "jobs", "lost")
    assert tuple(metrics.readiness(probes.where("error is null")).first()) == (True, 0, None, None)


def test_audit_chain_of_one_log(spark):
    import hashlib

    n = 3000
    events = spark.range(1, n + 1).selectExpr("id as seq", "concat('e', id) as id", "'u' as actor_id", "'a' as action", "'r' as resource_type", "cast(null as string) as resource_id", "'{}' as metadata_json", "timestamp_ntz '2024-01-01 00:00:00' as occurred_at")
    rows = integrity.chained(events.repartition(7)).orderBy("seq").collect()
    last = ""
    for r in rows:
        assert r.prev_hash == last
        last = hashlib.sha256(f"{r.seq}|{r.id}|u|a|r||{{}}|1704067200000000|{last}".encode()).hexdigest()
        assert r.hash == last
    whole = spark.createDataFrame(rows, integrity.chained(events).schema)
    assert len(rows) == n and integrity.chain_violations(whole).count() == 0
    assert [tuple(x) for x in integrity.chain_violations(whole.where("seq <> 100")).collect()] == [(101, "gap")]
    assert integrity.chained(events.limit(0)).count() == 0


def test_bloom_filter_never_misses(spark):
    entries = spark.range(2000).selectExpr("sha2(concat('x', id), 256) as hash")
    lookups = spark.range(6000).selectExpr("sha2(concat('x', id), 256) as hash")
    got = integrity.membership(lookups, entries).collect()
    assert len(got) == 6000 and sum(r.present for r in got) == 2000 and all(r.maybe for r in got if r.present)
    assert sum(r.maybe for r in got) < 2000 + 200  # 10 bits and 7 probes: about 0.8 % false
    assert integrity.membership(lookups, entries.limit(0)).where("maybe or present").count() == 0


def test_cron_step_after_a_value():
    assert cron.parse("5/20 * * * *").minutes == 1 << 5 and cron.parse("5-59/20 * * * *").minutes == 1 << 5 | 1 << 25 | 1 << 45


def test_parents_as_of(spark):
    backups = [("f1", "t", "s", "full", "2024-01-01 00:00:00"), ("i1", "t", "s", "incr", "2024-01-02 00:00:00"), ("i0", "t", "s", "incr", "2024-01-02 00:00:00"), ("f2", "t", "s", "full", "2024-01-05 00:00:00"), ("o", "u", "s", "full", "2024-01-01 00:00:00")]
    b = spark.createDataFrame(backups, "id string, target_id string, storage_id string, type string, at string").selectExpr("id", "target_id", "storage_id", "type", "cast(at as timestamp_ntz) as ended_at", "concat('m-', id) as manifest_id")
    due = [("d1", "incr", "2024-01-02 00:00:00"), ("d2", "diff", "2024-01-04 00:00:00"), ("d3", "incr", "2023-12-31 00:00:00"), ("d4", "full", "2024-01-09 00:00:00"), ("d5", "diff", "2024-01-05 00:00:00")]
    d = spark.createDataFrame(due, "id string, type string, at string").selectExpr("id", "'t' as target_id", "'s' as storage_id", "type", "cast(at as timestamp_ntz) as due_at")
    got = {r.id: (r.type, r.parent_id) for r in lineage.attach_parents(d, b, as_of=True).collect()}
    assert got == {"d1": ("incr", "i0"), "d2": ("diff", "f1"), "d3": ("full", None), "d4": ("full", None), "d5": ("diff", "f2")}


def test_restore_plans_of_many_long_chains(spark):
    """All of 1,500 backups in one chain: more than a million plan rows."""
    n = 1500
    b = spark.range(n).selectExpr("concat('b', id) as id", "if(id = 0, 'full', 'incr') as type", "if(id = 0, null, concat('b', id - 1)) as parent_id", "concat('m', id) as manifest_id")
    got = lineage.restore_plans(b, b.selectExpr("id as backup_id")).groupBy("backup_id").agg(F.count("*").alias("n"), F.max("step_no").alias("top"), F.max("problem").alias("p")).collect()
    assert len(got) == n and all(r.n == r.top == int(r.backup_id[1:]) + 1 and r.p == "" for r in got)


def test_too_long_manifests_are_refused_unread(spark, tmp_path, monkeypatch):
    (tmp_path / "a.manifest").write_text('{"id": "m", "version": 1}')
    (tmp_path / "b.manifest").write_text('{"id": "m2", "version": 1, "signature": "' + 100 * "x" + '"}')
    (tmp_path / "c.manifest").write_text("{")
    monkeypatch.setattr(stores, "MAX_MANIFEST_BYTES", 80)
    got = {r.path[-10:]: (r.id, r.problem) for r in stores.read_manifests(spark, str(tmp_path)).collect()}
    assert got == {"a.manifest": ("m", None), "b.manifest": (None, "too long"), "c.manifest": (None, "unreadable")}
    assert stores.exists(spark, str(tmp_path), "a.manifest") and not stores.exists(spark, str(tmp_path), "z")
