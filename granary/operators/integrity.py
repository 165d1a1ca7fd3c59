"""Integrity: hash chain of the audit log, references against stored objects, garbage, evidence."""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import ed25519
from granary.operators.folds import scan
from granary.session import checkpoint, importable, shared_dir

FIELDS = ("id", "actor_id", "action", "resource_type", "resource_id", "metadata_json")


def event_body() -> Column:
    body = [F.coalesce(F.col(c), F.lit("")) for c in FIELDS]
    return F.concat_ws("|", F.col("seq").cast("string"), *body, F.unix_micros(F.col("occurred_at").cast("timestamp")).cast("string"))


def event_digest(previous: Column) -> Column:
    """SHA-256 over the event and the digest of the one before."""
    return F.sha2(F.concat_ws("|", event_body(), previous), 256)


#: Events that one task chains; behind them another one goes on.
CHAINED = 1_000_000


def chained(events: DataFrame, at_once: int = CHAINED) -> DataFrame:
    """events with prev_hash and hash. Each event needs the digest before it, so the log is one fold in order of seq: serial, but no task has all of it.

    A longer log is dealt once to ranges of seq in the shared folder; a task folds one range from the digest that the range before ended with."""

    def step(last: str, body: str) -> tuple[str, tuple[str, str]]:
        digest = hashlib.sha256(f"{body}|{last}".encode()).hexdigest()
        return digest, (last, digest)

    fold = lambda part, last: scan(part, [], [F.col("seq")], {"body": event_body()}, last, step, {"prev_hash": T.StringType(), "hash": T.StringType()})
    n, lo, hi = events.agg(F.count("*"), F.min("seq"), F.max("seq")).first()
    if n <= at_once or lo == hi:
        return fold(events, "")
    spark = events.sparkSession
    number = F.coalesce(F.floor((F.col("seq") - lo) / (-(-(hi - lo + 1) * at_once // n))), F.lit(0)).cast("int")
    root = f"{shared_dir(spark).rstrip('/')}/chain-{uuid.uuid4().hex}"
    events.withColumn("__range", number).repartition("__range").write.partitionBy("__range").parquet(root)
    ranges = [r[0] for r in spark.read.parquet(root).select("__range").distinct().orderBy("__range").collect()]
    done, last = [], ""
    for k in ranges:
        part = checkpoint(fold(spark.read.schema(events.schema).parquet(f"{root}/__range={k}"), last))
        last = part.orderBy(F.desc_nulls_last("seq")).select("hash").first()[0]
        done.append(part)
    return reduce(DataFrame.unionAll, done)


def chain_violations(events: DataFrame) -> DataFrame:
    """(seq, problem) of events that break the order, the link to the one before or their own digest.

    The event before is found by an equi-join on the expected seq, so no sort of the whole log in one task is needed."""
    before = events.select((F.col("seq") + 1).alias("__seq"), F.col("hash").alias("__hash"))
    df = events.join(before, events["seq"] == before["__seq"], "left")
    first = F.col("seq") <= 1
    problem = (
        F.when(~first & F.col("__hash").isNull(), "gap").when(~F.col("prev_hash").eqNullSafe(F.when(first, F.lit("")).otherwise(F.col("__hash"))), "link")
        .when(F.col("hash") != event_digest(F.col("prev_hash")), "digest")
    )
    return df.select("seq", problem.alias("problem")).where("problem is not null")


def segment(size: int) -> Column:
    """The segment of an event: `size` sequence numbers each, from 0."""
    return F.floor((F.col("seq") - 1) / size).cast("long")


def segment_start(number: Column) -> Column:
    """What stands for the digest before a segment's first event."""
    return F.sha2(F.concat_ws("|", F.lit("segment"), number.cast("string")), 256)


def chained_segments(events: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(events with segment, prev_hash and hash; heads (segment, first_seq, last_seq, digest, prev_head, head)).

    Another form of the log: each segment is a chain of its own from a fixed start, so segments are chained by as many tasks; the last digests of the segments
    are chained in order by their heads, one row a segment. A change of any event changes its segment's digest and all heads from there on."""
    if size < 1:
        raise ValueError("a segment has at least one event")

    def step(last: str | None, body: str, start: str) -> tuple[str, tuple[str, str]]:
        before = start if last is None else last
        digest = hashlib.sha256(f"{body}|{before}".encode()).hexdigest()
        return digest, (before, digest)

    numbered = events.withColumn("segment", segment(size))
    chains = scan(numbered, ["segment"], [F.col("seq")], {"body": event_body(), "start": segment_start(F.col("segment"))}, None, step, {"prev_hash": T.StringType(), "hash": T.StringType()})
    ends = chains.groupBy("segment").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max_by("hash", "seq").alias("digest"))

    def head(last: str, body: str) -> tuple[str, tuple[str, str]]:
        digest = hashlib.sha256(f"{body}|{last}".encode()).hexdigest()
        return digest, (last, digest)

    body = F.concat_ws("|", *[F.col(c).cast("string") for c in ("segment", "first_seq", "last_seq", "digest")])
    return chains, scan(ends, [], [F.col("segment")], {"body": body}, "", head, {"prev_head": T.StringType(), "head": T.StringType()})


def segment_violations(events: DataFrame, heads: DataFrame, size: int) -> DataFrame:
    """(segment, seq, problem): of events those that break their segment's order, links or digests; of heads (seq null) those whose place, end or digest isn't the events', or that break their own chain.

    Everything is an equi-join on the number before, or an aggregate; no task has the whole log."""
    df = events.where("segment is not null")
    first = F.col("seq") == F.col("segment") * size + 1
    before = df.select((F.col("seq") + 1).alias("__seq"), F.col("hash").alias("__hash"))
    df = df.join(before, df["seq"] == before["__seq"], "left")
    problem = (
        F.when(F.col("segment") != segment(size), "segment").when(~first & F.col("__hash").isNull(), "gap")
        .when(~F.col("prev_hash").eqNullSafe(F.when(first, segment_start(F.col("segment"))).otherwise(F.col("__hash"))), "link").when(F.col("hash") != event_digest(F.col("prev_hash")), "digest")
    )
    bad = df.select("segment", "seq", problem.alias("problem")).where("problem is not null")
    ends = events.groupBy("segment").agg(F.min("seq").alias("__first"), F.max("seq").alias("__last"), F.max_by("hash", "seq").alias("__digest"))
    last = heads.select((F.col("segment") + 1).alias("segment"), F.col("head").alias("__head"), F.lit(True).alias("__follows"))
    h = heads.join(ends, "segment", "full").join(last, "segment", "left")
    body = F.concat_ws("|", *[F.col(c).cast("string") for c in ("segment", "first_seq", "last_seq", "digest")])
    start = F.col("segment") == 0
    wrong = (
        F.when(F.col("head").isNull(), "no head").when(F.col("__digest").isNull(), "no events").when(~start & F.col("__follows").isNull(), "gap")
        .when((F.col("first_seq") != F.col("__first")) | (F.col("last_seq") != F.col("__last")) | (F.col("digest") != F.col("__digest")), "end")
        .when(~F.col("prev_head").eqNullSafe(F.when(start, F.lit("")).otherwise(F.col("__head"))), "link").when(F.col("head") != F.sha2(F.concat_ws("|", body, "prev_head"), 256), "digest")
    )
    return bad.unionByName(h.select("segment", F.lit(None).cast(events.schema["seq"].dataType).alias("seq"), wrong.alias("problem")).where("problem is not null"))


def object_key(digest: Column) -> Column:
    return F.concat_ws("/", F.lit("data"), F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest)


def _brief(key: str) -> Column:
    """An object key in bytes: those of a digest of 64 lower-case hex digits, which its key repeats, take 33; others stay as they are, behind another first byte."""
    digest = F.substring(key, 12, 64)
    fits = digest.rlike("^[0-9a-f]{64}$") & (F.col(key) == object_key(digest))
    return F.when(fits, F.concat(F.lit(b"\1"), F.unhex(digest))).otherwise(F.concat(F.lit(b"\0"), F.col(key).cast("binary")))


def distinct_hashes(refs: DataFrame) -> DataFrame:
    """(hash), each once. Digests of 64 lower-case hex digits are exchanged as 32 bytes, behind a first byte that tells them from others."""
    digest = F.col("hash").rlike("^[0-9a-f]{64}$")
    brief = F.when(digest, F.concat(F.lit(b"\1"), F.unhex("hash"))).otherwise(F.concat(F.lit(b"\0"), F.col("hash").cast("binary")))
    short = refs.select(brief.alias("__brief")).distinct()
    rest = F.expr("substring(__brief, 2)")
    return short.select(F.when(F.hex(F.expr("substring(__brief, 1, 1)")) == "01", F.lower(F.hex(rest))).otherwise(rest.cast("string")).alias("hash"))


def orphans(objects: DataFrame, refs: DataFrame) -> DataFrame:
    """Stored objects under data/ that no reference names. Only those that pass a Bloom filter over the named keys are exchanged; the others are orphans where they are."""
    marked = checkpoint(refs.select(object_key(F.col("hash")).alias("object_key")).distinct())
    filter_, blocks = bloom_filter(marked.select(F.sha2("object_key", 256).alias("hash")))
    stored = objects.where(F.col("object_key").startswith("data/")).withColumn("hash", F.sha2("object_key", 256))
    judged = maybe_in(stored, checkpoint(filter_), blocks).drop("hash")
    lost = judged.where("not maybe").drop("maybe")
    return lost.unionByName(judged.where("maybe").drop("maybe").join(marked, "object_key", "left_anti"))


def garbage_totals(objects: DataFrame, refs: DataFrame, bad_manifests: int = 0) -> DataFrame:
    """scanned, referenced, orphans and their bytes; one unreadable manifest refuses it all."""
    if bad_manifests:
        raise ValueError(f"{bad_manifests} manifests could not be read; nothing is collected")
    stored = objects.where(F.col("object_key").startswith("data/")).select("object_key", "size", F.lit(1).alias("stored"), F.lit(False).alias("marked"), F.lit(False).alias("named"))
    marks = refs.select(object_key(F.col("hash")).alias("object_key"), F.lit(None).cast("long").alias("size"), F.lit(0).alias("stored"), F.lit(True).alias("marked"), (F.coalesce("hash", F.lit("")) != "").alias("named"))
    # objects and references meet once, by key, each read once and aggregated before the exchange
    keys = stored.unionByName(marks).groupBy(_brief("object_key").alias("key")).agg(F.sum("stored").alias("n"), F.sum("size").alias("bytes"), F.bool_or("marked").alias("marked"), F.bool_or("named").alias("named"))
    lost = ~F.col("marked")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return keys.agg(count("n").alias("scanned_chunks"), F.count_if("named").alias("referenced_chunks"), count(F.when(lost, F.col("n"))).alias("orphan_chunks"), count(F.when(lost, F.col("bytes"))).alias("orphan_bytes"))


def verify_manifests(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """For each manifest its references, those missing, and the stored bytes of the others."""
    df = refs.withColumn("object_key", object_key(F.col("hash"))).join(objects.withColumnRenamed("size", "stored"), "object_key", "left")
    return df.groupBy("manifest_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("stored").isNull()).alias("missing"), F.coalesce(F.sum("stored"), F.lit(0)).alias("stored_bytes"))


def missing_refs(refs: DataFrame, objects: DataFrame) -> DataFrame:
    return refs.withColumn("object_key", object_key(F.col("hash"))).join(objects, "object_key", "left_anti").select("manifest_id", "sequence", "object_key")


def verify_chunks(refs: DataFrame, stored: DataFrame, key: Column, opened) -> DataFrame:
    """(manifest_id, sequence, hash, problem) of references whose stored chunk is missing, can't be opened, or has another digest or size.

    refs: (manifest_id, sequence, hash, size); stored: (object_key, envelope, algorithm); opened(envelope, algorithm, key, digest) gives the plain bytes, or null."""
    df = refs.withColumn("object_key", object_key(F.col("hash"))).join(stored.select("object_key", "envelope", "algorithm"), "object_key", "left")
    df = df.withColumn("plain", opened(F.col("envelope"), F.col("algorithm"), key, F.col("hash").cast("binary")))
    problem = (
        F.when(F.col("envelope").isNull(), "missing").when(F.col("plain").isNull(), "unreadable").when(F.sha2("plain", 256) != F.col("hash"), "digest")
        .when(F.length("plain") != F.col("size"), "size")
    )
    return df.select("manifest_id", "sequence", "hash", problem.alias("problem")).where("problem is not null")


#: Bits for each entry of a Bloom filter, probes of each look-up, and bits of a block. Fixed values.
BLOOM_BITS, BLOOM_PROBES, BLOOM_BLOCK = 10, 7, 512
#: A filter of up to so many blocks (some 100 bytes each) is broadcast.
BROADCAST_BLOCKS = 400_000
#: Of up to so many manifests the ids are broadcast (some 50 bytes each).
BROADCAST_MANIFESTS = 500_000


WORDS = BLOOM_BLOCK // 64


def _placed(df: DataFrame, blocks: int) -> DataFrame:
    """df with the block that holds all of a hash's bits, by its first 60 bits, and the places of these in it: seven times 9 bits, from three hex digits each."""
    number = lambda at, n: F.conv(F.substring("hash", at, n), 16, 10).cast("long")
    place = lambda column, digits: F.shiftright(column, 4 * digits).bitwiseAND(F.lit(BLOOM_BLOCK - 1)).cast("int")
    parts = df.select("*", F.pmod(number(1, 15), F.lit(blocks)).alias("block"), number(16, 15).alias("__a"), number(31, 6).alias("__b"))
    places = [place("__a", 12 - 3 * i) for i in range(5)] + [place("__b", 3), place("__b", 0)]
    return parts.select(*df.columns, "block", *[p.alias(f"__p{i}") for i, p in enumerate(places)])


def bloom_filter(entries: DataFrame) -> tuple[DataFrame, int]:
    """(block, words) over distinct hashes, the words an array of eight longs, and the number of blocks (at least one)."""
    blocks = max(1, -(-BLOOM_BITS * entries.count() // BLOOM_BLOCK))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.col(f"__p{i}") % 64)
    none = F.lit(0).cast("long")
    words = [reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.shiftright(f"__p{i}", 6) == w, bit(i)).otherwise(none) for i in range(BLOOM_PROBES)]) for w in range(WORDS)]
    marked = _placed(entries.select("hash"), blocks).groupBy("block").agg(*[F.bit_or(word).alias(f"w{w}") for w, word in enumerate(words)])
    return marked.select("block", F.array(*[f"w{w}" for w in range(WORDS)]).alias("words")), blocks


def maybe_in(lookups: DataFrame, filter_: DataFrame, blocks: int) -> DataFrame:
    """lookups with `maybe`: false only for hashes that the filter's entries don't have. One row a look-up, one join; the filter is broadcast while it has few blocks."""
    df = _placed(lookups, blocks).join(F.broadcast(filter_) if blocks <= BROADCAST_BLOCKS else filter_, "block", "left")
    bit = lambda i: F.call_function("shiftright", F.get("words", F.shiftright(f"__p{i}", 6)), F.col(f"__p{i}") % 64).bitwiseAND(F.lit(1).cast("long"))
    hit = reduce(lambda a, b: a & b, [bit(i) == 1 for i in range(BLOOM_PROBES)])
    return df.select(*lookups.columns, F.coalesce(hit, F.lit(False)).alias("maybe"))


def held_refs(refs: DataFrame, manifests: DataFrame) -> DataFrame:
    """refs of some manifests (manifest_id). The manifests are counted first: up to BROADCAST_MANIFESTS of them are broadcast, and no reference is exchanged."""
    held = checkpoint(manifests.select("manifest_id").distinct())
    return refs.join(F.broadcast(held) if held.count() <= BROADCAST_MANIFESTS else held, "manifest_id", "left_semi")


def membership(lookups: DataFrame, entries: DataFrame) -> DataFrame:
    """lookups (hash, ...) with `maybe` (a blocked Bloom filter over `entries`: never false for a member) and `present` (exact).

    Only look-ups that pass the filter are exchanged, for the exact join; those that miss stay where they are. A null hash is no member."""
    held = checkpoint(entries.select("hash").where("hash is not null").distinct())
    filter_, blocks = bloom_filter(held)
    judged = maybe_in(lookups, checkpoint(filter_), blocks)
    passed = judged.where("maybe").join(held.withColumn("present", F.lit(True)), "hash", "left").select(*judged.columns, F.coalesce("present", F.lit(False)).alias("present"))
    return passed.unionByName(judged.where("not maybe").withColumn("present", F.lit(False)))


def canonical(*fields: str) -> Column:
    """JSON of the fields in the order given, without blanks; null fields are left out, as a signature is."""
    return F.to_json(F.struct(*fields))


def _spread(df: DataFrame, by: Column) -> DataFrame:
    """Rows that cost far more to work on than to move, over all tasks of a shuffle, however few bytes they are."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(by))


def signed(manifests: DataFrame, seeds: DataFrame, body: Column) -> DataFrame:
    """manifests with `signature` (algorithm and hex value) of the canonical body under the secret seed of their key; seeds: (key_id, seed)."""
    importable(manifests.sparkSession)
    df = _spread(manifests.withColumn("__body", body).join(seeds.select("key_id", "seed"), "key_id", "left"), F.col("__body"))
    value = F.lower(F.hex(ed25519.signatures("seed", "__body")))
    return df.withColumn("signature", F.when(F.col("seed").isNotNull(), F.struct(F.lit("ed25519").alias("algorithm"), value.alias("value")))).drop("__body", "seed")


def signature_problems(manifests: DataFrame, keys: DataFrame, body: Column) -> DataFrame:
    """manifests with `problem`: no signature, unknown algorithm, unknown key, or bad signature; null only where the signature of the canonical body is right.

    manifests has signature (algorithm, value in hex) and key_id; keys: (key_id, public_key). A key that is listed with two values is no key. Those that fail
    otherwise are not verified."""
    importable(manifests.sparkSession)
    known = keys.groupBy("key_id").agg(F.min("public_key").alias("__public"), F.countDistinct("public_key").alias("__n")).where("__n = 1 and key_id is not null").drop("__n")
    df = manifests.join(known, "key_id", "left").withColumn("__body", body)
    value, name = F.col("signature.value"), F.col("signature.algorithm")
    early = F.when(value.isNull() | name.isNull(), "no signature").when(name != "ed25519", "unknown algorithm").when(F.col("__public").isNull(), "unknown key")
    df = _spread(df.withColumn("__early", early), F.col("__body"))
    good = ed25519.signed_by(F.when(F.col("__early").isNull(), F.col("__public")), F.col("__body"), F.try_to_binary(value, F.lit("hex")))
    return df.withColumn("__good", good).withColumn("problem", F.coalesce("__early", F.when(~F.col("__good"), "bad signature"))).drop("__public", "__body", "__early", "__good")


def dedup(refs: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """refs with `duplicate`: another one with the same hash comes first (by manifest, sequence). A minimum per hash, aggregated before the
    shuffle, and a join: no sort of a hot hash's references."""
    keys = [*(scope or []), "hash"]
    place = F.struct("manifest_id", "sequence")
    first = refs.groupBy(*keys).agg(F.min(place).alias("__first"))
    return refs.join(first, keys).withColumn("duplicate", place != F.col("__first")).drop("__first")


def dedup_counts(refs: DataFrame) -> DataFrame:
    """(hash, refs, duplicates) of refs (manifest_id, sequence, hash), a place counted once: all but the first place of a hash are duplicates, so counting needs no join and no marks."""
    counted = refs.groupBy("hash").agg(F.countDistinct(F.struct("manifest_id", "sequence")).alias("refs"))
    return counted.withColumn("duplicates", F.col("refs") - 1)


def dedup_stats(flagged: DataFrame, by: list[str]) -> DataFrame:
    fresh = ~F.col("duplicate")
    out = flagged.groupBy(*by).agg(
        F.count("*").alias("chunks"), F.sum("size").alias("bytes_in"), F.count_if(fresh).alias("uploaded_chunks"), F.count_if("duplicate").alias("deduped_chunks"),
        F.coalesce(F.sum(F.when(fresh, F.col("size"))), F.lit(0)).alias("bytes_uploaded"),
    )
    return out.withColumn("dedup_ratio", F.coalesce(F.try_divide(F.col("deduped_chunks"), F.col("chunks")), F.lit(0.0)))


def dedup_totals(refs: DataFrame) -> DataFrame:
    """The figures of `dedup_stats` for each manifest_id of refs (manifest_id, sequence, hash, size), without marking references.

    A hash is uploaded once, by its first place: so one aggregate by hash says what each manifest uploads, another by manifest what it has. No join on hashes, and
    references that repeat a place count as duplicates."""
    uploads = refs.groupBy("hash").agg(F.min(F.struct("manifest_id", "sequence", "size")).alias("first"))
    uploads = uploads.groupBy(F.col("first.manifest_id").alias("manifest_id")).agg(F.count("*").alias("uploaded_chunks"), F.sum("first.size").alias("bytes_uploaded"))
    out = refs.groupBy("manifest_id").agg(F.count("*").alias("chunks"), F.sum("size").alias("bytes_in")).join(uploads, "manifest_id", "left").fillna(0, ["uploaded_chunks", "bytes_uploaded"])
    out = out.withColumn("deduped_chunks", F.col("chunks") - F.col("uploaded_chunks"))
    return out.withColumn("dedup_ratio", F.coalesce(F.try_divide(F.col("deduped_chunks"), F.col("chunks")), F.lit(0.0)))


def evidence(jobs: DataFrame) -> DataFrame:
    """Content-addressed evidence of finished restore jobs: payload, sha256 and id."""
    payload = F.to_json(F.struct(F.col("id").alias("job_id"), "status", "target_id", "storage_id"))
    df = jobs.where("operation = 'restore' and status in ('succeeded', 'failed')").select(F.col("id").alias("job_id"), payload.alias("payload"))
    df = df.withColumn("sha256", F.sha2("payload", 256))
    return df.withColumn("id", F.concat(F.lit("restore-evidence-"), F.col("sha256"))).dropDuplicates(["sha256"])
