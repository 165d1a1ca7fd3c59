"""Signatures, objects put if absent, and what else guards the stores."""

from __future__ import annotations

import hashlib
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from granary.functions import ed25519
from granary.operators import integrity
from granary.sources import objects, stores

# signatures


#: Seed, public key, message and signature of the published test vectors 1 to 3 and the one of SHA-512("abc").
VECTORS = [
    ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
    ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ("c5aa8df43f9f837bedb7442f31dcb7b166d38535076f094b85ce3a2e0b4458f7", "fc51cd8e6218a1a38da47ed00230f0580816ed13ba3303ac5deb911548908025", "af82", "6291d657deec24024827e69c3abe01a30ce548a284743a445e3680d7db5ac3ac18ff9b538d16f290ae67f760984dc6594a7c15e9716ed28dc027beceea1ec40a"),
    ("833fe62409237b9d62ec77587520911e9a759cec1d19755b7da901b96dca3d42", "ec172b93ad5e563bf4932c70e1245034c35467ef2efd4d64ebf819683467e2bf", hashlib.sha512(b"abc").hexdigest(), "dc2a4459e7369633a52b1bf277839a00201009a3efbf3ecb69bea2186c26b58909351fc9ac90b3ecfdfbc7c66431e0303dca179c138ac17ad9bef1177331a704"),
]


def test_published_signatures():
    items = []
    for seed, public, message, signature in [tuple(map(bytes.fromhex, v)) for v in VECTORS]:
        assert ed25519.public_key(seed) == public and ed25519.sign(seed, message) == signature
        items.append((public, message, signature))
    assert ed25519.verify(items) == [True] * 4
    for i in range(64):  # any changed byte
        public, message, signature = items[i % 4]
        broken = signature[:i] + bytes([signature[i] ^ 1 << i % 8]) + signature[i + 1 :]
        assert ed25519.verify([(public, message, broken), items[1]]) == [False, True]
    large = int.from_bytes(items[0][2][32:], "little") + ed25519.L  # the same number, not reduced
    assert ed25519.verify([(items[0][0], b"", items[0][2][:32] + large.to_bytes(32, "little"))]) == [False]
    assert ed25519.verify([(b"", b"", b""), (items[0][0], b"", b"\xff" * 64), (b"\xff" * 32, b"", items[0][2])]) == [False] * 3


def test_batches_find_the_wrong_ones():
    seeds = [bytes([i]) * 32 for i in range(3)]
    items = [(ed25519.public_key(seeds[i % 3]), b"m%d" % i, ed25519.sign(seeds[i % 3], b"m%d" % i)) for i in range(300)]
    assert all(ed25519.verify(items))
    wrong = {0, 17, 18, 255, 256, 299}
    mixed = [(p, m + b"!" * (i in wrong), s) for i, (p, m, s) in enumerate(items)]
    assert {i for i, ok in enumerate(ed25519.verify(mixed)) if not ok} == wrong
    assert not any(ed25519.verify([(p, m, items[i - 1][2]) for i, (p, m, _) in enumerate(items[:40])])) and ed25519.verify([]) == []



def test_signatures_with_and_without_libcrypto(monkeypatch):
    seed, message = b"\x07" * 32, b"manifest"
    public, signature = ed25519.public_key(seed), ed25519.sign(seed, message)
    # R with a point of order two added: right by the equation with the cofactor only
    a, _ = ed25519._secret(seed)
    point = ed25519.encode(ed25519.add(ed25519.times_base(5), (0, ed25519.P - 1, 1, 0)))
    shifted = point + ((5 + ed25519._number(point, public, message) * a) % ed25519.L).to_bytes(32, "little")
    items = [(public, message, signature), (public, b"other", signature), (public, message, shifted)]
    assert ed25519.verify(items) == [True, False, True]
    if ed25519._crypto() is not None:
        with monkeypatch.context() as m:  # what libcrypto accepts costs no arithmetic in Python
            m.setattr(ed25519, "combine", None)
            m.setattr(ed25519, "times_base", None)
            assert ed25519.sign(seed, message) == signature and ed25519.verify(items[:1]) == [True]
    monkeypatch.setattr(ed25519, "_crypto", lambda: None)
    assert ed25519.sign(seed, message) == signature and ed25519.verify(items) == [True, False, True]


def test_manifests_load_closed(spark, tmp_path):
    seed, other = b"\x01" * 32, b"\x02" * 32
    seeds = spark.createDataFrame([("k", seed), ("o", other)], "key_id string, seed binary")
    rows = [(f"m{i}", "j", "t", "s", "full", "k" if i % 2 else "o", 1) for i in range(6)]
    manifests = spark.createDataFrame(rows, "id string, job_id string, target_id string, storage_id string, type string, key_id string, version int")
    names = [f.name for f in stores.T._parse_datatype_string(stores.MANIFEST).fields]
    full = manifests.select(*[F.col(n) if n in manifests.columns else F.lit(None).cast(f.dataType).alias(n) for n, f in zip(names, stores.T._parse_datatype_string(stores.MANIFEST).fields, strict=True) if n != "signature"])
    signed = integrity.signed(full.withColumn("finished_at", F.lit("2026-04-23 02:07:00").cast("timestamp_ntz")), seeds, stores.manifest_body())
    root = f"file://{tmp_path}"
    outcome = objects.put_manifests(signed, F.to_json(F.struct(*names)), root)
    assert {r.object_key: r.outcome for r in outcome.collect()} == {f"manifests/2026/04/23/m{i}.manifest": "written" for i in range(6)}
    assert {r.outcome for r in objects.put_manifests(signed, F.to_json(F.struct(*names)), root).collect()} == {"exists"}
    folder = tmp_path / "manifests/2026/04/23"
    change = lambda i, f: (folder / f"m{i}.manifest").write_text(json.dumps(f(json.loads((folder / f"m{i}.manifest").read_text()))))
    change(1, lambda m: m | {"target_id": "other-target"})
    change(2, lambda m: {k: v for k, v in m.items() if k != "signature"})
    change(3, lambda m: m | {"version": 99})
    (folder / "x.manifest").write_text("no manifest")
    keys = spark.createDataFrame([("k", ed25519.public_key(seed)), ("o", ed25519.public_key(other)), (None, b"x")], "key_id string, public_key binary")
    good, bad = stores.load_manifests(spark, root, keys)
    assert {r.id for r in good.collect()} == {"m0", "m4", "m5"}
    assert {r.path.rsplit("/", 1)[1]: r.problem for r in bad.collect()} == {"m1.manifest": "bad signature", "m2.manifest": "no signature", "m3.manifest": "version", "x.manifest": "unreadable"}
    good, bad = stores.load_manifests(spark, root, keys.where("key_id = 'k'"))
    assert {r.id for r in good.collect()} == {"m5"} and bad.where("problem = 'unknown key'").count() == 2
    assert stores.load_manifests(spark, root, keys.union(keys.selectExpr("key_id", "cast('y' as binary)")))[0].count() == 0  # a key with two values is none


# objects


def visible(root):
    return sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file() and ".staging" not in p.parts)


def frame(spark, rows):
    return spark.createDataFrame([(k, v.encode()) for k, v in rows], "object_key string, content binary")


def test_put_if_absent_once(spark, tmp_path):
    root = f"file://{tmp_path}/o"
    first = objects.put_objects(frame(spark, [("data/a", "one"), ("data/b", "two"), ("data/b", "three")]).repartition(3), root).collect()
    assert sorted((r.object_key, r.outcome) for r in first) == [("data/a", "written"), ("data/b", "exists"), ("data/b", "written")]
    assert {r.sha256 for r in first if r.object_key == "data/a"} == {hashlib.sha256(b"one").hexdigest()}
    again = objects.put_objects(frame(spark, [("data/a", "other"), ("data/c", "new")]), root).collect()
    assert sorted((r.object_key, r.outcome) for r in again) == [("data/a", "exists"), ("data/c", "written")]
    assert (tmp_path / "o/data/a").read_text() == "one" and visible(tmp_path / "o") == ["data/a", "data/b", "data/c"]
    assert [r.object_key for r in stores.objects(spark, root).collect()] == ["data/a", "data/b", "data/c"]
    assert os.listdir(tmp_path / "o/.staging") == []
    assert objects.put_objects(frame(spark, []), root).collect() == []


def test_concurrent_jobs_have_one_winner_a_key(spark, tmp_path):
    root, keys, got = f"file://{tmp_path}/o", [f"data/{i:02}" for i in range(30)], {}

    def put(job):
        got[job] = {r.object_key: r.outcome for r in objects.put_objects(frame(spark, [(k, f"{job}:{k}") for k in keys]).repartition(4), root).collect()}

    threads = [threading.Thread(target=put, args=(j,)) for j in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(got) == 4
    for k in keys:
        winners = [j for j in got if got[j][k] == "written"]
        assert len(winners) == 1 and (tmp_path / "o" / k).read_text() == f"{winners[0]}:{k}"


def test_a_lost_task_leaves_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/o"

    def dies(batches):
        import os
        import time

        for b in batches:
            yield b
            if "data/7" in b.column(0).to_pylist():
                time.sleep(1)
                os._exit(1)

    df = frame(spark, [(f"data/{i}", "x") for i in range(8)]).repartition(4)
    with pytest.raises(Exception, match="(?i)crash|exit|lost|fail"):
        objects.put_objects(df.mapInArrow(dies, df.schema), root)
    assert visible(tmp_path / "o") == [] and os.listdir(tmp_path / "o/.staging") == []
    for bad in ("/abs", "a/../b", "", "a\\b", ".staging/x", "a//b", None):
        with pytest.raises(Exception, match="no object key"):
            objects.put_objects(spark.createDataFrame([("ok", b"1"), (bad, b"2")], "object_key string, content binary"), root)
    with pytest.raises(Exception, match="bytes, not"):
        objects.put_objects(spark.createDataFrame([("short", b"abc", 4)], "object_key string, content binary, size long"), root)
    assert visible(tmp_path / "o") == []
    with pytest.raises(ValueError, match="hard links"):
        objects.put_objects(df, "s3://bucket/x")


def test_publishing_may_be_repeated(spark, tmp_path):
    root = f"file://{tmp_path}/o"
    objects.stage(frame(spark, [("a", "1"), ("b", "2")]), root, "job")
    assert visible(tmp_path / "o") == []
    (tmp_path / "o/b").write_text("taken")
    for _ in range(2):
        assert {r.object_key: r.outcome for r in objects.publish(spark, root, "job").collect()} == {"a": "written", "b": "exists"}


def test_head_asks_for_one_path(spark, tmp_path):
    (tmp_path / "data").mkdir()
    for name in ("a", "b.tmp", "c.lock"):
        (tmp_path / "data" / name).write_text("abc")
    assert stores.head(spark, str(tmp_path), "data/a")[0] == 3 and stores.head(spark, str(tmp_path), "data") is None and stores.head(spark, str(tmp_path), "z") is None
    assert stores.exists(spark, str(tmp_path), "data/a") and not stores.exists(spark, str(tmp_path), "data")
    assert [r.object_key for r in stores.objects(spark, str(tmp_path)).collect()] == ["data/a"]


# ids


def test_time_ordered_ids(spark):
    from granary.functions import ids

    at = lambda s: F.lit(s).cast("timestamp_ntz")
    rows = spark.range(500).select((at("2026-04-24 12:00:00") + F.expr("make_interval(0, 0, 0, 0, 0, 0, id / 1000)")).alias("t"), "id")
    made = rows.select("t", ids.time_ordered_id(F.col("t"), F.col("id")).alias("v"), ids.time_ordered_id(F.col("t")).alias("r")).orderBy("t").collect()
    for column in ("v", "r"):
        texts = [x[column] for x in made]
        assert texts == sorted(texts) and len(set(texts)) == 500  # a millisecond apart
        assert all(len(x) == 36 and x[14] == "7" and x[19] in "89ab" for x in texts)
    assert {x.v[19] for x in made} == set("89ab") and {x.r[19] for x in made} == set("89ab")
    back = spark.createDataFrame(made).select(ids.made_at(F.col("v")).alias("a"), "t", (F.col("v") >= ids.first_id(F.col("t"))).alias("ok")).collect()
    assert all(x.a == x.t and x.ok for x in back)
    odd = spark.range(1).select(ids.time_ordered_id(at("1969-12-31 23:59:59")).alias("a"), ids.time_ordered_id(F.lit(None).cast("timestamp_ntz")).alias("b"), ids.made_at(F.lit("no id")).alias("c")).first()
    assert tuple(odd) == (None, None, None)
