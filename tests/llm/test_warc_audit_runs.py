"""WARC archives, filter audit and periodic runs: against plain versions and SQL, and on the odd cases."""

from __future__ import annotations

import gzip
import hashlib
import random
import re
import uuid
import zlib
from fractions import Fraction
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import common, filter_audit, periodic, sql, warc
from granary.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def same(df, text, **tables):
    """Rows of a DataFrame and of DuckDB SQL over small tables."""
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table.toArrow())
    want = con.sql(text)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(r) for r in df.select(columns).collect()), key=key)
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)
    return got


# lookup


def test_lookup_of_hot_keys(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 7 == 0, None).otherwise(F.col("id")).alias("k"))
    values = spark.createDataFrame([(7, "hot"), (11, "cold"), (1_000_000, "unused")], "k long, v string")
    got = common.lookup(rows, values, ["k"], rows.groupBy("k").agg(F.count("*").alias("n")))
    assert {(r.id, r.v) for r in got.collect()} == {(r.id, {7: "hot", 11: "cold"}.get(r.k)) for r in rows.collect()}
    none = common.lookup(rows.limit(0), values, ["k"], rows.limit(0).groupBy("k").agg(F.count("*").alias("n")))
    assert none.collect() == [] and none.columns == ["id", "k", "v"]


# 11


PAGES = "page_id long, url string, html string, payload_bytes string"
ODD_PAGES = [
    (3, "http://a/", "same", "x"), (1, "http://a/\r\nX: y", "same", None), (9, None, "same", None), (None, "u", "same", None), (4, "u", None, None), (5, "u", "", None), (6, "u", "é" * 5000, None),
    (6, "v", "é" * 5000, None), (7, "u", "\r\n0\r\n\r\nWARC/1.1\r\n", None), (None, "u", "alone", None), (8, "u", "x" * 3_000_000, None), (10, "u", "x" * 64, None),
]


def archive(spark, pages, tmp_path, **sizes):
    return warc.write(warc.page_records(pages), f"file://{tmp_path}/{uuid.uuid4().hex}", **sizes)


@pytest.mark.parametrize("sizes", [{}, {"segment": 64}, {"segment": 37, "archive": 3000}])
def test_pages_through_archives(spark, tmp_path, sizes):
    small = [r for r in ODD_PAGES if r[0] != 8] if sizes else ODD_PAGES
    pages = spark.createDataFrame(small, PAGES)
    archives = archive(spark, pages, tmp_path, **sizes)
    found = warc.read_pages(archives)
    assert found.where("problem is not null").count() == 0
    same(found.drop("problem"), sql.OP11, pages=pages)
    if sizes.get("archive"):
        assert archives.count() > 4 and archives.agg(F.sum("records")).first()[0] > 200


def test_payloads_come_back(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", random.Random(i).randbytes(n).hex()) for i, n in enumerate([0, 1, 40, 5000, 70_000])], "page_id long, url string, html string")
    found = warc.records(archive(spark, pages, tmp_path, segment=1000), payloads=True).where("headers['WARC-Type'] = 'response'")
    back: dict[int, list] = {}
    for r in found.collect():
        back.setdefault(int(r.headers[warc.PAGE]), []).append((r.piece, r.payload or b""))
        assert r.problem is None
    assert {k: b"".join(x for _, x in sorted(v)).decode() for k, v in back.items()} == {r.page_id: r.html for r in pages.collect()}


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_pages(archive(spark, pages, tmp_path)).collect() == []


def record(kind, block, **more):
    fields = {"WARC-Type": kind, "Content-Type": "application/http"} | {k.replace("_", "-"): v for k, v in more.items()} | {"Content-Length": str(len(block))}
    return b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields.items()) + b"\r\n" + block + b"\r\n\r\n"


def read(spark, tmp_path, *files):
    names = []
    for data in files:
        name = tmp_path / f"{uuid.uuid4().hex}.warc"
        name.write_bytes(data)
        names.append((f"file://{name}",))
    rows = warc.records(spark.createDataFrame(names, "archive string")).collect()
    return {r.headers.get("WARC-Record-ID"): (r.payload_bytes, r.problem) for r in rows}


def test_segments_in_any_order_and_archive(spark, tmp_path):
    block = warc.http_block(b"0123456789" * 100, chunk=7)
    cuts = [block[:5], block[5:700], block[700:701], block[701:]]
    total = {"WARC_Segment_Total_Length": str(len(block))}

    def part(k, origin="<o>", **more):
        own = {"WARC_Record_ID": origin} if k == 1 else {"WARC_Record_ID": f"<{origin}{k}>", "WARC_Segment_Origin_ID": origin}
        return record("response" if k == 1 else "continuation", cuts[k - 1], **own, WARC_Segment_Number=str(k), **(total if k == 4 else {}), **more)

    assert read(spark, tmp_path, part(3) + part(1), gzip.compress(part(4)) + gzip.compress(part(2))) == {"<o>": (1000, None)}
    assert read(spark, tmp_path, part(1) + part(2) + part(4))["<o>"][1] == "segment missing"
    assert read(spark, tmp_path, part(1) + part(2) + part(3))["<o>"][1] == "no last segment"
    assert read(spark, tmp_path, part(2) + part(3) + part(4))["<o>"][1] == "no first segment"
    assert read(spark, tmp_path, part(1) + part(2) + part(2) + part(3) + part(4))["<o>"][1] == "segment twice"
    total["WARC_Segment_Total_Length"] = "77"
    assert read(spark, tmp_path, part(1) + part(2) + part(3) + part(4))["<o>"][1] == "total length"


def test_foreign_and_broken_records(spark, tmp_path):
    head = b"HTTP/1.1 200 OK\r\n"
    chunked = head + b"Transfer-Encoding: Chunked\r\n\r\n"
    cases = {
        "<chunks>": (chunked + b"3;x=y\r\nabc\r\n0A\r\n0123456789\r\n0\r\nTrailer: 1\r\n\r\n", (13, None)), "<length>": (head + b"content-length: 4\r\n\r\nabcd", (4, None)), "<short>": (head + b"Content-Length: 5\r\n\r\nabcd", (4, "content length")),
        "<open>": (head + b"\r\nall of it", (9, None)), "<size>": (chunked + b"zz\r\nabc", (0, "chunk size")), "<sign>": (chunked + b"-1\r\nabc", (0, "chunk size")), "<end>": (chunked + b"3\r\nabcd\r\n0\r\n\r\n", (3, "chunk end")),
        "<cut>": (chunked + b"5\r\nabc", (3, "chunks cut off")), "<more>": (chunked + b"0\r\n\r\nmore", (0, "bytes after the last chunk")), "<none>": (b"HTTP/1.1 200 OK\r\n", (0, "http header")), "<empty>": (b"", (0, "http header")),
    }
    data = b"".join(record("response", block, WARC_Record_ID=name) for name, (block, _) in cases.items())
    assert read(spark, tmp_path, data) == {name: want for name, (_, want) in cases.items()}
    assert read(spark, tmp_path, gzip.compress(data)) == {name: want for name, (_, want) in cases.items()}
    wrong = record("response", chunked + b"1\r\na\r\n0\r\n\r\n", WARC_Record_ID="<d>", WARC_Payload_Digest="sha1:" + "A" * 32)
    assert read(spark, tmp_path, wrong) == {"<d>": (1, "payload digest")}
    assert read(spark, tmp_path, wrong[:-30])["<d>"][1] == "record cut off"
    assert read(spark, tmp_path, gzip.compress(wrong)[:-20])[None][1] == "archive cut off"
    assert read(spark, tmp_path, b"no archive")[None][1] == "no record here"
    assert read(spark, tmp_path, b"") == {}


def test_body_in_pieces():
    payload = random.Random(5).randbytes(3000)
    block = warc.http_block(payload, chunk=100)
    for size in (1, 2, 3, 50, 4000):
        body = warc.Body(True)
        assert b"".join(body.feed(block[i : i + size]) for i in range(0, len(block), size)) == payload and body.end() is None


# 12


DOCS = "doc_id long, text string, source string, mask string"
LABELS = "doc_id long, quality int, toxic int"


def test_audit_of_odd_rows(spark):
    r = random.Random(3)
    texts = [None, "", " \n\t ", "A B C", "a $ b", " ".join(f"w{i}" for i in range(60)), " ".join("ab"[i % 2] for i in range(60)), "É" * 50 + " ABC", "x\x0by\x0cz", "W" * 200_000]
    rows = [(r.choice([None, *range(40)]), r.choice(texts), r.choice([None, "", "p", "q", "q"]), "m") for _ in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(r.choice([None, *range(50)]), r.choice([None, 0, 1]), r.choice([None, 0, 1])) for _ in range(80)], LABELS)
    got = same(filter_audit.audit(docs, labels), sql.OP12, documents=docs, labels=labels)
    assert len(got) == 600 * 3
    assert filter_audit.audit(docs.limit(0), labels).collect() == []
    assert filter_audit.audit(docs, labels.limit(0)).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


@pytest.mark.parametrize("names", ["x", "xy", "abcdef"])
def test_interactions_of_any_filters(spark, names):
    """Kept, removed and shares of every order from the masks themselves."""
    r, n = random.Random(len(names)), len(names)
    counts = {m: (r.randrange(50), r.randrange(9), r.randrange(9)) for m in range(1 << n) if r.random() < 0.6} | {0: (5, 1, 1)}
    got = {(x.filter_order, x.step): x for x in filter_audit.interactions(spark.createDataFrame([("", m, *c) for m, c in counts.items()], "part string, mask int, docs long, good long, toxic long"), names).collect()}
    shares = dict.fromkeys(names, 0)
    for order in permutations(names):
        gone = 0
        for step, c in enumerate(order, 1):
            bit = 1 << names.index(c)
            here = [sum(v[k] for m, v in counts.items() if m & bit and not m & gone) for k in range(3)]
            x = got["".join(order), step]
            assert (x.removed, x.good_lost, x.toxic_lost) == tuple(here)
            assert x.redundant == sum(v[0] for m, v in counts.items() if m & bit and m & gone) and x.unique_fails == counts.get(bit, (0,))[0]
            gone |= bit
            assert x.kept == sum(v[0] for m, v in counts.items() if not m & gone)
            shares[c] += here[0]
    assert all(x.shapley == shares[o[s - 1]] for (o, s), x in got.items())
    with pytest.raises(ValueError):
        filter_audit.interactions(spark.createDataFrame([], "part string, mask int, docs long, good long, toxic long"), names + names)


# 13


def plain_runs(w, shortest=24, exponent=3):
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(shortest, exponent * q) and not any(all(w[i + k] == w[i + k + r] for k in range(length - r)) for r in range(1, q)):
                out.append((i, length, q))
            i = max(i, j) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("shortest, exponent", [(24, 3), (2, 2), (6, 2), (9, 3), (1, 4)])
def test_repetitions(shortest, exponent):
    r = random.Random(shortest)
    for _ in range(80):
        texts = []
        for _ in range(r.randrange(1, 6)):
            k, w = r.randrange(1, 4), []
            while r.random() < 0.8 and len(w) < 200:
                w += [r.randrange(k) for _ in range(r.randrange(1, 14))] * r.randrange(1, 7)
                w += [9] * (r.random() < 0.3)
            texts.append(w)
        offsets = np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)
        found = [[] for _ in texts]
        for d, *run in zip(*[x.tolist() for x in periodic.repetitions(np.array(sum(texts, []), np.int64), offsets, shortest, exponent)], strict=True):
            found[d].append(tuple(run))
        assert found == [plain_runs(w, shortest, exponent) for w in texts]


def plain_row(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if n and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w)
    dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in dropped))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 20000")
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, sf).select(COLUMNS).collect()}
    assert any(r[1] for r in got.values())
    for r in docs.collect():
        assert got[r.doc_id] == plain_row(r.doc_id, r.text)


def test_runs_of_odd_rows(spark, tmp_path):
    r = random.Random(8)
    unit = [f"w{r.randrange(99)}" for _ in range(9)]
    long = " ".join(f"w{i % 9973}x{i // 9973}" for i in range(150_000)) + " " + "ab cd\x0b" * 40_000
    texts = [None, "", " \n ", "one", "one " * 23, "one " * 24, "one\t" * 25, " ".join(unit * 3), " ".join(unit[:8] * 3), " ".join(unit * 4 + ["x"] + unit * 3), " ".join(["y"] * 50 + unit * 3 + ["y"] * 24), "é è  " * 30]
    rows = [(r.choice([None, *range(200)]), t) for t in texts * 12]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_periodic_runs"](spark, str(tmp_path)).select(COLUMNS).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, got), key=key) == sorted((plain_row(*x) for x in rows), key=key)
    odd = spark.createDataFrame([(1, long, ["x"], "y")], "doc_id long, text string, runs array<string>, collapsed string")
    found = periodic.find(odd).select("row.doc_id", "row.runs", "runs", "collapsed").first()
    assert found[1] == ["x"] and [(x.start, x.length, x.period) for x in found[2]] == [(150_000, 80_000, 2)] and len(found.collapsed.split(" ")) == 150_002
    assert periodic.find(odd.limit(0)).collect() == []
