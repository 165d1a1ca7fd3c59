"""Content ids, late materialisation and streamed restores."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary import queries
from granary.functions import chunking
from granary.functions.blake3 import IV, PERMUTATION, digest_column
from granary.plans import backup, restore

M32 = 2**32 - 1


def plain_blake3(data: bytes) -> str:
    """The hash by its recursive definition, word by word."""

    def compress(cv, words, counter, length, flags):
        v = [*cv, *map(int, IV[:4]), counter & M32, counter >> 32, length, flags]
        turn = lambda x, n: (x >> n | x << (32 - n)) & M32

        def g(a, b, c, d, x, y):
            for add, r1, r2 in ((x, 16, 12), (y, 8, 7)):
                v[a] = (v[a] + v[b] + add) & M32
                v[d] = turn(v[d] ^ v[a], r1)
                v[c] = (v[c] + v[d]) & M32
                v[b] = turn(v[b] ^ v[c], r2)

        m = list(words)
        for _ in range(7):
            for i in range(4):
                g(i, 4 + i, 8 + i, 12 + i, m[2 * i], m[2 * i + 1])
            for i in range(4):
                g(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, m[8 + 2 * i], m[9 + 2 * i])
            m = [m[i] for i in PERMUTATION]
        return [v[i] ^ v[i + 8] for i in range(8)]

    def node(part, counter, root):
        if len(part) <= 1024:
            cv = list(map(int, IV))
            blocks = [part[i : i + 64] for i in range(0, len(part), 64)] or [b""]
            for i, b in enumerate(blocks):
                words = np.frombuffer(b.ljust(64, b"\0"), "<u4").tolist()
                cv = compress(cv, words, counter, len(b), (i == 0) | 2 * (i == len(blocks) - 1) | 8 * (root and i == len(blocks) - 1))
            return cv
        leaves = -(-len(part) // 1024)
        left = 1024 << ((leaves - 1).bit_length() - 1)
        children = node(part[:left], counter, False) + node(part[left:], counter + left // 1024, False)
        return compress(list(map(int, IV)), children, 0, 64, 4 | 8 * root)

    return np.array(node(data, 0, True), "<u4").tobytes().hex()


def test_blake3_known_answers():
    assert digest_column(pa.array([b"", b"abc", None], pa.binary())) == ["af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85", None]
    # of the published vectors: bytes that count up to 250
    counted = bytes(i % 251 for i in range(102_400))
    known = {1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213", 1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444", 102_400: "bc3e3d41a1146b069abffad3c0d44860cf664390afce4d9661f7902e7943e085"}
    assert digest_column(pa.array([counted[:n] for n in known], pa.binary())) == list(known.values())


def test_blake3_at_leaf_and_level_bounds():
    data = random.Random(1).randbytes(40_000)
    sizes = [n + d for n in (0, 64, 128, 960, 1024, 2048, 3072, 4096, 5120, 7168, 8192, 9216, 16_384, 17_408, 31_744, 32_768) for d in (-1, 0, 1) if n + d >= 0]
    values = [data[:n] for n in sizes]
    assert digest_column(pa.array(values, pa.binary())) == [plain_blake3(v) for v in values]
    sliced = pa.array([b"x", *values, b"y"], pa.binary()).slice(3, 20)
    assert digest_column(sliced) == [plain_blake3(v) for v in values[2:22]]
    assert digest_column(pa.array([], pa.binary())) == []


def test_blake3_of_the_table(spark, sf):
    got = {(r.doc_id, r.algo): r.hash for r in queries.QUERIES["c3_blake3_ids"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 3000").collect()
    for r in docs[:60]:
        assert got[r.doc_id, "blake3"] == plain_blake3(r.text.encode()) and got[r.doc_id, "sha256"] == hashlib.sha256(r.text.encode()).hexdigest()
    odd = spark.createDataFrame([(None, "blake3"), (b"a", "md5"), (b"", "sha256")], "data binary, algo string").select(chunking.content_id(F.col("data"), F.col("algo")).alias("h"))
    assert [r.h for r in odd.collect()] == [None, None, hashlib.sha256(b"").hexdigest()]


def seal():
    return F.lit(b"0123456789abcdef"), F.lit("k1"), F.lit("none")


def streams_of(spark, n, size):
    """Streams of which every third one equals the first; bytes that don't compress."""
    rows = [(f"s{i:03}", np.random.default_rng(0 if i % 3 == 0 else i).bytes(size)) for i in range(n)]
    return spark.createDataFrame(rows, "stream string, data binary").repartition(4)


def flow(spark, streams, existing=None, algo="blake3", **kw):
    refs = backup.references(streams, algo, (256, 1024, 4096)).withColumns({"manifest_id": F.col("stream"), "sequence": F.col("part").cast("long")})
    return backup.uploaded(refs, streams, existing if existing is not None else spark.createDataFrame([], "object_key string"), *seal(), **kw)


@pytest.mark.parametrize("algo", ["sha256", "blake3"])
@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_upload_and_restore(spark, algo, broadcast):
    streams = streams_of(spark, 12, 9000)
    refs, objects = flow(spark, streams, algo=algo, broadcast=broadcast)
    rows = refs.collect()
    stored = {r.object_key for r in objects.select("object_key").collect()}
    assert objects.count() == len(stored) == len({r.hash for r in rows}) == sum(not r.duplicate for r in rows)
    assert all((r.stored_size == 0) == r.duplicate and r.algo == algo for r in rows)
    assert {r.manifest_id for r in rows if r.duplicate} == {"s003", "s006", "s009"}  # the first by name is the one stored
    back = {r.stream: r for r in restore.restored(restore.opened_pieces(refs, objects, seal()[0])).collect()}
    assert {k: r.digest for k, r in back.items()} == {r.stream: hashlib.sha256(r.data).hexdigest() for r in streams.collect()}
    again, none = flow(spark, streams, objects.select("object_key"), algo=algo, broadcast=broadcast)
    assert none.count() == 0 and again.where("not duplicate").count() == 0
    with pytest.raises(ValueError, match="named"):
        backup.references(streams.union(streams))


def shuffled(spark, work):
    """Bytes that a piece of work wrote to exchanges."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    work()
    return total() - before


def test_exchanges_do_not_carry_payload(spark):
    """Four times the bytes in as many chunks: the exchanges stay as they are."""

    def run(size, scale):
        made = streams_of(spark, 24, size)
        streams = spark.createDataFrame(made.collect(), made.schema)

        def work():
            refs = backup.references(streams, "sha256", (256 * scale, 1024 * scale, 4096 * scale)).withColumns({"manifest_id": F.col("stream"), "sequence": F.col("part").cast("long")})
            refs, objects = backup.uploaded(refs, streams, spark.createDataFrame([], "object_key string"), *seal())
            objects.write.format("noop").mode("overwrite").save()

        return shuffled(spark, work)

    small, large = run(16_000, 1), run(256_000, 16)
    assert large < 2 * small and large < 24 * 256_000 / 20


def piece(stream, i, data, algo="sha256", /, **wrong):
    digest = hashlib.sha256(data).hexdigest() if algo == "sha256" else plain_blake3(data)
    return tuple((dict(stream=stream, sequence=i, size=len(data), hash=digest, algo=algo, data=data) | wrong).values())


PIECES = "stream string, sequence long, size long, hash string, algo string, data binary"


def test_restore_names_the_first_problem(spark, tmp_path):
    good = [piece(s, i, f"{s}{i}".encode() * 50, a) for s, a in (("a", "sha256"), ("b", "blake3")) for i in range(20)]
    bad = {
        "gap": [piece("gap", 0, b"x"), piece("gap", 2, b"z")], "first": [piece("first", 1, b"x")], "twice": [piece("twice", 0, b"x"), piece("twice", 0, b"x")], "lost": [piece("lost", 0, b"x", data=None)],
        "size": [piece("size", 0, b"x"), piece("size", 1, b"xy", size=3)], "digest": [piece("digest", 0, b"x", data=b"y")], "b3": [piece("b3", 0, b"x", "blake3", data=b"y")],
    }
    rows = good + [p for x in bad.values() for p in x]
    random.Random(2).shuffle(rows)
    found = {r.stream: r for r in restore.restored(spark.createDataFrame(rows, PIECES), f"file://{tmp_path}/out").collect()}
    assert {k: r.problem for k, r in found.items()} == {"a": None, "b": None, "gap": "gap at 2", "first": "gap at 1", "twice": "repeated at 0", "lost": "unreadable at 0", "size": "size at 1", "digest": "digest at 0", "b3": "digest at 0"}
    whole = b"".join(f"b{i}".encode() * 50 for i in range(20))
    assert found["b"].digest == hashlib.sha256(whole).hexdigest() and found["b"].size == len(whole) and open(found["b"].path, "rb").read() == whole
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(hashlib.sha256(s.encode()).hexdigest() for s in "ab")
    assert restore.restored(spark.createDataFrame([], PIECES)).collect() == []


def test_a_stream_longer_than_a_row(spark):
    """2.2 GB in pieces of 1 MB: no row, batch or Python object has more than a batch of them."""
    n, size = 2200, 1 << 20
    data = F.expr(f"cast(repeat('0123456789abcdef', {size // 16}) as binary)")
    part = b"0123456789abcdef" * (size // 16)
    pieces = spark.range(0, n, 1, 8).select(F.lit("long").alias("stream"), F.col("id").alias("sequence"), F.lit(size).cast("long").alias("size"), F.lit(hashlib.sha256(part).hexdigest()).alias("hash"), F.lit("sha256").alias("algo"), data.alias("data"))
    want = hashlib.sha256()
    for _ in range(n):
        want.update(part)
    row = restore.restored(pieces).first()
    assert (row.digest, row.size, row.pieces, row.problem) == (want.hexdigest(), n * size, n, None)
