"""MinHash near-dedup with min-max hashing.

One pass turns each text into its set of five-word shingles. Each of PERMUTATIONS hash functions gives two
signature values, the least and the greatest hash of the set, so half as many hashes are worked out as the
signature has values; both agree between two sets with the probability of their similarity. BANDS bands of ROWS values give
each text as many bucket keys.

How alike two texts can be is bounded before they are compared: shingles that no other candidate has can't be shared,
so with sizes n and n - u shingles that are not its own, two texts share at most the lesser n - u. Texts that can't reach the
threshold with any size in their bucket leave it. A sketch of SKETCH * 64 parities bounds the difference of two sets from below, and
pairs beyond what the threshold allows are not compared. Both bounds are exact, so nothing is lost by them. Hubs are those with the fewest shingles of their own. So in a large group
of copies of one text, with changes here and there, the text itself is the first hub, what is close enough is connected to it at once, and what
is too far from all is never compared.

Texts with the same set are one class, told by a 128-bit digest of the sorted set, and only the class
goes on, under a number of its own. In a bucket no pairs are enumerated: in each round some members are hubs, and every member that is not yet known to be
connected to a hub is compared with it on full sets. Members that the links found so far connect count as one. A bucket is done once its members
are all connected, or all have been hubs; the number of hubs grows eightfold from round to round, so there are few
rounds, and every two texts of a bucket are compared, once, unless they are connected anyway. So nothing but the banding can miss a link:
a pair at the threshold shares no bucket with odds of (1 - 0.85**4)**20 = 4e-7.
A bucket of more than SALT members is worked on in parts: its hubs go to each part, its members to one.

Defined results: a text of fewer words than five is one shingle; null and empty texts have none and are
linked with nothing; rows that repeat an id are one document, linked with what any of their texts is linked with; a row with a null id is not linked and is kept; an empty table
gives an empty one; other columns stay with `keep_first` and are left out of `classes`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import checkpoint, components, importable
from granary.llm.text import mix, runs, shingles, words

SIZE = 5
BANDS, ROWS = 20, 4
#: Words of a parity sketch.
SKETCH = 8
PERMUTATIONS = BANDS * ROWS // 2
PERCENT = 85
#: Members of a bucket that meet its hubs in one task.
SALT = 1000

_draw = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
MULTIPLY, ADD = _draw[:PERMUTATIONS] | np.uint64(1), _draw[PERMUTATIONS:]
LONG_SET = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType()))])


def min_max(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Signatures (rows of 2 * PERMUTATIONS values) of the non-empty sets x[offsets[i]:offsets[i+1]]."""
    out = np.empty((len(offsets) - 1, 2 * PERMUTATIONS), np.uint64)
    y = np.empty_like(x)
    for k in range(PERMUTATIONS):
        np.multiply(x, MULTIPLY[k], out=y)
        y += ADD[k]
        out[:, 2 * k] = np.minimum.reduceat(y, offsets[:-1])
        out[:, 2 * k + 1] = np.maximum.reduceat(y, offsets[:-1])
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A hash for each band. A band takes its values from different permutations, as the two of one depend on each other in small sets."""
    spread = signatures.reshape(len(signatures), PERMUTATIONS, 2).transpose(0, 2, 1).reshape(len(signatures), BANDS, ROWS)
    key = np.zeros(spread.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + spread[:, :, r])
    return key


def parities(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each set 64 * SKETCH bits: the parity of how many of its hashes fall on the bit."""
    bits = 64 * SKETCH
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    odd = np.bincount(row * bits + (x & np.uint64(bits - 1)).astype(np.int64), minlength=(len(offsets) - 1) * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, bits), axis=1, bitorder="little").view(np.int64)


def sets_of(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each text)."""
    for at, data, off in runs(column):
        h, _, _, to = words(data, off)
        x, to = shingles(h, to, SIZE)
        yield at, [np.unique(x[a:b]) for a, b in zip(to[:-1], to[1:], strict=True)]


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (null without shingles), bands, sketch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in sets_of(batch.column(1)):
                n = np.array([len(s) for s in sets])
                some = [s for s in sets if len(s)]
                keys: list = [None] * len(sets)
                bands: list = [None] * len(sets)
                sketches: list = [None] * len(sets)
                if some:
                    x, to = np.concatenate(some), np.concatenate([[0], np.cumsum(n[n > 0])])
                    rows = band_keys(min_max(x, to)).view(np.int64)
                    for i, s, r, p in zip(np.flatnonzero(n).tolist(), some, rows, parities(x, to), strict=True):
                        keys[i], bands[i], sketches[i] = xxhash.xxh3_128_digest(s.tobytes()), r, p
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, LONG_SET)


def full_sets(docs: DataFrame) -> DataFrame:
    """node, packed: the sorted shingle hashes as bytes, of those rows (node, set_key, text) whose text has that set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in sets_of(batch.column(2)):
                part = batch.slice(at, len(sets))
                blobs = [s.tobytes() for s in sets]
                same = pa.array([xxhash.xxh3_128_digest(x) == k for x, k in zip(blobs, part.column(1).to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(blobs, pa.binary())], names=["node", "packed"]).filter(same)

    return docs.select("node", "set_key", "text").mapInArrow(work, "node long, packed binary")


def own_shingles(packed: DataFrame) -> DataFrame:
    """(node, u): how many of a candidate's shingles no other candidate has; without those that have none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(1)]
                node = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(x) for x in sets])
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(np.concatenate(sets) if sets else [], pa.int64())], names=["node", "shingle"])

    held = packed.mapInArrow(work, "node long, shingle long").groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("last"))
    return held.where("node = last").groupBy("node").agg(F.count("*").alias("u"))


def _salted(buckets: DataFrame) -> DataFrame:
    """A row for each part of the buckets (column salts: how many each has)."""
    return buckets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))


def _possible(members: DataFrame, percent: int) -> DataFrame:
    """Members that can still be similar enough to one of their bucket, by the least size in it."""
    least = _salted(members.groupBy("band", "key").agg(F.min("n").alias("least"), F.max("salts").alias("salts"))).drop("salts")
    shared = F.col("n") - F.col("u")
    return members.join(least, ["band", "key", "salt"]).where(100 * shared >= percent * (F.col("n") + F.greatest("least", shared) - shared)).drop("least")


def confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the pairs whose sets a and b are similar enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("u", "v", "a", "b").mapInArrow(work, "u long, v long")


def classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    importable(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = checkpoint(signatures(docs))
    known = rows.where("set_key is not null and doc_id is not null")
    # One row for each distinct set, numbered for good by the checkpoint; equal sets have equal bands.
    distinct = known.groupBy("set_key").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    distinct = checkpoint(distinct.withColumn("node", F.monotonically_increasing_id()))
    slots = distinct.select("node", "n", F.posexplode("bands").alias("band", "key"))
    shared = slots.groupBy("band", "key").count().where("count > 1").select("band", "key", F.ceil(F.col("count") / SALT).cast("int").alias("salts"))
    members = slots.join(shared, ["band", "key"])
    members = checkpoint(members.select("band", "key", "node", "n", "salts", F.pmod(F.xxhash64("node", "band"), F.col("salts")).cast("int").alias("salt")))
    found = None
    if not members.isEmpty():
        wanted = distinct.join(members.select("node").distinct(), "node", "left_semi").select("node", "set_key", F.col("least").alias("doc_id"))
        texts = docs.join(wanted, "doc_id").withColumn("same", F.xxhash64("text")).dropDuplicates(["doc_id", "node", "same"])
        packed = checkpoint(full_sets(texts))
        # Only members get a sketch: it would weigh more than all else if it went through the search for shared buckets.
        members = members.join(own_shingles(packed), "node", "left").join(distinct.select("node", "sketch"), "node")
        members = members.select("band", "key", "salt", "salts", "node", "n", "sketch", F.coalesce("u", F.lit(0)).alias("u"), F.col("node").alias("component"))
        found = _link(checkpoint(_possible(members, percent)), packed, percent)
    sets = distinct.select("set_key", "node", "least")
    # An id with several sets links them.
    several = known.groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo <> hi").select("doc_id")
    several = checkpoint(several)
    if not several.isEmpty():
        of = known.join(several, "doc_id").select("doc_id", "set_key").distinct().join(sets.select("set_key", "node"), "set_key")
        if found is not None:
            of = of.join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("node"))
        pairs = of.join(of.groupBy("doc_id").agg(F.min("node").alias("first")), "doc_id").select(F.col("node").alias("u"), F.col("first").alias("v"))
        ids = components(pairs).toDF("component", "next")
        labels = sets.select("node") if found is None else sets.select("node").join(found, "node", "left")
        labels = labels.withColumn("component", F.col("node") if found is None else F.coalesce("component", "node"))
        found = labels.join(ids, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    if found is None:
        tied = sets.select("set_key", F.col("least").alias("component"))
    else:
        tied = sets.join(found, "node", "left").select("set_key", "least", F.coalesce("component", "node").alias("group"))
        first = tied.groupBy("group").agg(F.min("least").alias("component"))
        tied = tied.join(first, "group").select("set_key", "component")
    tied = checkpoint(tied)
    out = rows.select("doc_id", "n_shingles", "set_key").join(tied, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    return out


def _link(members: DataFrame, packed: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the nodes that links connect; `members` start as components of their own."""
    labels = members.select("node", "component").distinct()
    done, width = 0, 1
    tested = None
    while not members.isEmpty():
        # Among texts with as few own shingles, the order of hubs differs from bucket to bucket.
        ranked = members.withColumn("slot", F.struct("u", F.xxhash64("band", "key", "node").alias("rank"), "node"))
        hubs = _least(ranked.select("band", "key", "salts", "slot", "n", "sketch", "component"), done, width)
        shared = F.least(F.col("n") - F.col("u"), F.col("hub_n") - F.col("hub_slot.u"))
        able = 100 * shared >= percent * (F.col("n") + F.col("hub_n") - shared)
        # Two sets differ in at least as many elements as their parities do in bits.
        differ = sum((F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("hub_sketch")[i])) for i in range(SKETCH)), F.lit(0))
        able = able & ((100 + percent) * differ <= (100 - percent) * (F.col("n") + F.col("hub_n")))
        pairs = ranked.join(_salted(hubs).drop("salts"), ["band", "key", "salt"]).where((F.col("slot") > F.col("hub_slot")) & (F.col("component") != F.col("hub_component")) & able)
        pairs = pairs.select("node", "hub", "component", "hub_component", F.least("node", "hub").alias("p"), F.greatest("node", "hub").alias("q")).dropDuplicates(["p", "q"])
        if tested is not None:  # two texts meet in many buckets and rounds, and are compared once
            pairs = pairs.join(tested, ["p", "q"], "left_anti")
        pairs = checkpoint(pairs)
        tested = pairs.select("p", "q") if tested is None else checkpoint(tested.union(pairs.select("p", "q")))
        done, width = done + width, 8 * width
        step = None
        if not pairs.isEmpty():
            full = pairs.join(packed.toDF("node", "a"), "node").join(packed.toDF("hub", "b"), "hub")
            # Confirmed links hold between whole components.
            links = confirmed(full.select(F.col("component").alias("u"), F.col("hub_component").alias("v"), "a", "b"), percent)
            step = components(links).toDF("component", "next")
            labels = labels.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
            members = members.join(step, "component", "left").select("band", "key", "salt", "salts", "node", "n", "sketch", "u", F.coalesce("next", "component").alias("component"))
            members = checkpoint(members)
        open_ = members.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m"), F.max("salts").alias("salts")).where(f"lo <> hi and m > {done + 1}").select("band", "key", "salts")
        members = checkpoint(members.join(_salted(open_).drop("salts"), ["band", "key", "salt"]))
    return labels


def _least(ranked: DataFrame, skip: int, take: int) -> DataFrame:
    """From each bucket the members in places skip to skip + take."""
    fields = F.struct("slot", "n", "component", "sketch", "salts")
    if skip == 0 and take == 1:
        hubs = ranked.groupBy("band", "key").agg(F.min(fields).alias("x"))
    else:
        from pyspark.sql import Window

        # Spark keeps only the first rows of each group on both sides of the shuffle (window group limit).
        order = Window.partitionBy("band", "key").orderBy("slot")
        placed = ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= skip + take).where(F.col("place") > skip)
        hubs = placed.select("band", "key", fields.alias("x"))
    x = F.col("x")
    return hubs.select("band", "key", x.slot.node.alias("hub"), x.slot.alias("hub_slot"), x.n.alias("hub_n"), x.component.alias("hub_component"), x.sketch.alias("hub_sketch"), x.salts.alias("salts"))


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each group, the one with the least id, with the columns of docs; rows with null ids stay."""
    gone = checkpoint(classes(docs, percent).where("not kept").select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
